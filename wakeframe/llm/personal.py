"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers (format, gazetteer, cue words before, cue words against, boundaries) each
vote for, against or not at all. Expectation-maximisation over the counts of vote patterns, a table whose
size the labelers bound, estimates how reliable each labeler is and how likely each pattern is personal
data. A logistic model on simple features of the span then learns from those likelihoods and decides on the
proposed spans. Spans of the base patterns stay whatever it says; accepted others that overlap none of them
are added.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.llm.stored import stored

CONTEXT = 40

# The base patterns, by kind in the order in which spans are listed. A repeated part takes all it
# can without giving back, and a match starts where its run of characters does, or where the match before ended:
# the same matches as those of the plain forms, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Given names that begin a name without a title (fixed values).
GIVEN_NAMES = """
James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George
Kevin Brian Edward Peter Henry Frank Patrick Jack Samuel Benjamin Alexander Adam Simon Oliver Lucas Martin Stefan Klaus
Hans Jürgen Wolfgang Dieter Uwe Jan Pierre Jean Michel François Philippe Louis Antoine José Juan Carlos Luis Miguel Javier
Pedro Pablo Diego Fernando Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra
Emily Michelle Laura Rebecca Anna Emma Julia Sophie Marie Claire Camille Isabelle Nathalie Monika Ursula Petra Sabine Katrin
Heike María Carmen Ana Isabel Lucía Elena Cristina Marta Jane Alice Helen Ruth Olivia Charlotte Victoria Diana
""".split()
# Proposals beyond the base kinds: addresses spelt out, numbers without a plus, numbers of persons and accounts, names,
# keys and tokens (by their makers' prefixes, as long runs of hexadecimal digits, or assigned), passwords. Each starts where
# its run of characters does and takes all of it, so time is linear and no length is cut.
_NAME = r"\p{Lu}[\p{L}'-]++"
_ASSIGNED = r"[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?"
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![A-Za-z0-9+(.-])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])",
    "person_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}}\p{{L}}*+\.?\x20\p{{Lu}})(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20{_NAME}|(?:{'|'.join(GIVEN_NAMES)})\x20{_NAME})(?:\x20{_NAME})?",
    "token": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++|[0-9a-fA-F]{32,}+"
    rf"|(?<=(?i:token|secret|api[_\x20-]?key|access[_\x20-]?key|bearer|credential){_ASSIGNED})[A-Za-z0-9+/_.=-]{{12,}}+)(?![A-Za-z0-9_-])",
    "password": rf"(?<=(?i:password|passwd|passphrase|pwd|kennwort|passwort|contraseña){_ASSIGNED})[^\s\"',;=:][^\s\"',;]{{3,}}+",
}
KINDS = [*BASE, *[k for k in MORE if k not in BASE]]
# What a text needs for a pattern to be worth a search.
DIGIT = "[0-9]"
NEEDS = {"email": "@", "ip": DIGIT, "phone": DIGIT, "card": DIGIT, "person_id": DIGIT, "iban": DIGIT, "name": r"\p{Lu}[\p{L}'.-]*+\x20\p{Lu}", "token": DIGIT, "password": "(?i:pass|pwd|kennw|contras)"}
# Fixed word lists of the gazetteer and of the cues.
DOMAINS = "com org net edu gov mil int info biz io de fr es it nl uk us eu ch at be ca au jp example test".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
BANK_COUNTRIES = "AT BE CH CZ DE DK EE ES FI FR GB GR HU IE IT LT LU LV NL NO PL PT RO SE SI SK".split()
CUES = {
    "email": "mail|contact|write|send|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|client|adresse",
    "card": "card|visa|credit|debit|payment|karte|tarjeta|carte",
    "phone": "call|phone|tel|mobile|fax|dial|contact|anruf|llam|appel",
    "person_id": "ssn|social|security|insurance|identity",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "name": "name|dear|signed|patient|employee|contact|regards|sincerely|meet|called",
    "token": "token|secret|key|auth|bearer|credential|session",
    "password": "pass|pwd|kennwort|contrase|login|user",
}
AGAINST = r"version|release|isbn|issn|invoice|order|serial|model|figure|table|page|section|build|\bv\.?\s*$|[$€#]\s*$"
LABELERS = ["format", "gazetteer", "cue", "against", "edges"]


def _candidates(kind: str, pattern: str, base: bool) -> Column:
    """Matches in ``text`` as (kind, k, gap, left, hit, right, proposed); gap counts the characters since the last one.

    The pieces between the matches give their places: no position function is needed.
    """
    found = F.array(F.struct(F.split("text", pattern, -1).alias("pieces"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hits")))
    each = F.transform(
        found,
        lambda p: F.transform(
            p["hits"],
            lambda hit, k: F.struct(
                F.lit(kind).alias("kind"),
                F.lit(base).alias("base"),
                k.alias("k"),
                F.length(F.get(p["pieces"], k)).alias("gap"),
                F.right(F.get(p["pieces"], k), F.lit(CONTEXT)).alias("left"),
                hit.alias("hit"),
                F.left(F.get(p["pieces"], k + 1), F.lit(CONTEXT)).alias("right"),
            ),
        ),
    )
    needed = NEEDS[kind] if base else {"email": r"[\[(]at[\])]"}.get(kind, NEEDS[kind])
    none = F.array().cast("array<struct<kind:string,base:boolean,k:int,gap:int,left:string,hit:string,right:string>>")
    # Most texts hold no match: one search that stops at the first spares them the cutting.
    return F.when(F.col("text").rlike(needed) & F.col("text").rlike(pattern), F.flatten(each)).otherwise(none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    backwards = F.transform(F.split(F.reverse(_digits(c)), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(F.filter(backwards, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _format(kind: Column, hit: Column) -> Column:
    """Whether a match passes the checks of its kind."""
    n = F.length(_digits(hit))
    parts = F.forall(F.split(hit, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    return (
        F.when(kind == "ip", parts)
        .when(kind == "card", n.between(16, 19) & _luhn(hit))
        .when(kind == "phone", n.between(8, 15))
        .when(kind == "person_id", ~hit.rlike("^(000|666|9..)|-00-|-0000$"))
        .when(kind == "token", hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~hit.rlike(r"^(.)\1*$"))
        .when(kind == "password", ~hit.rlike(r"^(?i:is|was|must|should|reset|change|none|null|true|false)\b"))
        .otherwise(F.lit(True))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes() -> dict[str, Column]:
    """One column for each of LABELERS: 1 for, -1 against, 0 no opinion."""
    kind, hit, left, right = F.col("kind"), F.col("hit"), F.lower("left"), F.lower("right")
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = cue | ((kind == k) & left.rlike(words))
    code = F.regexp_extract(hit, r"^\+([0-9]+)", 1)
    listed = (
        F.when(kind == "email", F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(DOMAINS))
        .when((kind == "phone") & hit.startswith("+"), F.array_contains(F.array(*[F.lit(c) for c in CALLING_CODES]), F.left(code, F.lit(2))) | F.left(code, F.lit(1)).isin("1", "7"))
        .when(kind == "card", F.left(hit, F.lit(1)).isin("3", "4", "5", "6"))
        .when(kind == "ip", ~hit.rlike(r"^(0|127|255)\."))
        .when(kind == "iban", F.left(hit, F.lit(2)).isin(BANK_COUNTRIES))
        .when((kind == "name") & F.regexp_extract(hit, r"^(\p{L}+)", 1).isin(GIVEN_NAMES), F.lit(True))
        .when((kind == "token") & hit.rlike(r"^(AKIA|gh[pousr]_|[sr]k_|xox|AIza|eyJ)|^[0-9a-f]+$|^[0-9A-F]+$"), F.lit(True))
    )
    inside = F.col("left").rlike(r"[\p{L}\p{N}]$") | F.col("right").rlike(r"^[\p{L}\p{N}]")
    return {
        "format": F.when(F.col("valid"), 1).otherwise(-1),
        "gazetteer": F.coalesce(_vote(listed, ~listed), F.lit(0)),
        "cue": _vote(cue, F.lit(False)),
        "against": _vote(F.lit(False), left.rlike(AGAINST) | right.rlike(r"^\s*(%|€|\$)")),
        "edges": _vote(~inside, inside),
    }


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> tuple[dict, dict]:
    """Expectation-maximisation over (kind, votes, count): ({(labeler, truth): {vote: chance}}, {(kind, votes): chance of truth}).

    Labelers are taken as independent given the truth; each kind has its own share of true spans. The start
    trusts every labeler somewhat; counts are smoothed, so a vote never seen keeps a chance.
    """
    n = len(LABELERS)
    # A vote's first chances, if the span is personal data and if it is not (fixed start).
    chance = {(j, t): {1: 0.6 if t else 0.2, 0: 0.3, -1: 0.1 if t else 0.5} for j in range(n) for t in (0, 1)}
    share = {k: 0.5 for k, _, _ in patterns}
    belief: dict = {}
    for _ in range(rounds):
        for kind, votes, _ in patterns:
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum(math.log(chance[j, 1][v] / chance[j, 0][v]) for j, v in enumerate(votes))
            belief[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        for j in range(n):
            for t in (0, 1):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for kind, votes, count in patterns:
                    mass[votes[j]] += count * (belief[kind, votes] if t else 1 - belief[kind, votes])
                total = sum(mass.values())
                chance[j, t] = {v: m / total for v, m in mass.items()}
        for k in share:
            own = [(belief[x, v], c) for x, v, c in patterns if x == k]
            share[k] = (1 + sum(b * c for b, c in own)) / (2 + sum(c for _, c in own))
    return chance, belief


@dataclass(frozen=True)
class SpanModel:
    """Weights of the features of a span; ``chance`` is a column expression."""

    intercept: float
    weights: tuple[float, ...]

    def chance(self) -> Column:
        total = F.lit(self.intercept)
        for w, f in zip(self.weights, _features()):
            total = total + F.lit(w) * f
        return 1 / (1 + F.exp(-total))


def _buckets() -> dict[str, Column]:
    """Features that are no votes, in few values each."""
    size = F.length("hit")
    return {
        "size": F.least(F.floor(size / 4), F.lit(8)).cast("int"),
        "digits": F.floor(4 * F.length(_digits(F.col("hit"))) / size).cast("int"),
        "opens": F.col("left").rlike(r"(^|[\s\"'(<\[])$").cast("int"),
        "closes": F.col("right").rlike(r"^($|[\s\"')>\].,;:!?])").cast("int"),
    }


def _features() -> list[Column]:
    kinds = [(F.col("kind") == k).cast("double") for k in KINDS]
    votes = [(F.col(x) == v).cast("double") for x in LABELERS for v in (1, -1)]
    return [*kinds, *votes, F.col("size") / 8.0, F.col("digits") / 4.0, F.col("opens").cast("double"), F.col("closes").cast("double")]


def learn(spans: DataFrame) -> SpanModel:
    """The span classifier from all voted spans; only counts of patterns, whose number is bounded, leave the cluster."""
    keys = ["kind", *LABELERS]
    counted = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = [(r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counted]
    if not patterns:
        return SpanModel(0.0, tuple(0.0 for _ in _features()))
    _, belief = estimate(patterns)
    spark = spans.sparkSession
    truth = spark.createDataFrame([(k, *v, b) for (k, v), b in belief.items()], "kind string, " + ", ".join(f"{x} int" for x in LABELERS) + ", belief double")
    table = spans.groupBy(*keys, "size", "digits", "opens", "closes").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(truth), keys)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("belief").alias("part")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("belief")).alias("part"))))
    rows = table.withColumn("as", both).select(
        F.col("as.label").alias("label"), (F.col("n") * F.col("as.part") + 1e-6).alias("weight"), array_to_vector(F.array(*_features())).alias("features")
    )
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=30).fit(rows.coalesce(1))
    return SpanModel(float(model.intercept), tuple(float(w) for w in model.coefficients.toArray()))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans ARRAY<STRUCT<kind, start, end, value, base, chance>>), one row for each row of ``docs``.

    Places count code points, end exclusive. Spans are ordered by kind as in KINDS, then by start. A base span
    is a match of BASE that passes its checks; failing matches are proposals like those of MORE and are added
    if the classifier gives them ``threshold`` or more, their format does not vote against them, and they
    overlap neither a base span nor an added one further left. A null or empty text has no spans (an empty
    array). Rows that repeat an id, or lack one, are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    order = {k: i for i, k in enumerate(KINDS)}
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_found = F.concat(*[_candidates(k, p, True) for k, p in BASE.items()], *[_candidates(k, p, False) for k, p in MORE.items()])
    base = stored(text.select("doc_id", all_found.alias("found")).withColumn("row", F.monotonically_increasing_id()), "span-proposals")

    rows = base.filter(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    behind = W.partitionBy("row", "kind", "base").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("hit")
    placed = rows.withColumn("end", F.sum(F.col("gap") + size).over(behind)).withColumn("start", F.col("end") - size)
    checked = placed.withColumn("valid", _format(F.col("kind"), F.col("hit"))).withColumn("base", F.col("base") & F.col("valid"))
    voted = stored(checked.withColumns(_votes()).withColumns(_buckets()).drop("k", "gap", "left", "right"), "span-votes")
    model = learn(voted)

    good = voted.withColumn("chance", model.chance()).filter(F.col("base") | (F.col("valid") & (F.col("chance") >= threshold)))
    line = W.partitionBy("row").orderBy("start", "end", "base")
    before, after = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(1, W.unboundedFollowing)
    clear = good.withColumns(
        {"reached": F.max("end").over(before), "next": F.min(F.when(F.col("base"), F.col("start"))).over(after)}
    ).filter(F.col("base") | ((F.col("start") >= F.coalesce("reached", F.lit(0))) & (F.coalesce(F.col("end") <= F.col("next"), F.lit(True)))))
    rank = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    one = F.struct(rank.alias("rank"), "start", "end", "kind", F.col("hit").alias("value"), "base", "chance")
    grouped = clear.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("list"))
    shape = "array<struct<kind:string,start:bigint,end:bigint,value:string,base:boolean,chance:double>>"
    spans = F.transform("list", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], s["base"], s["chance"])).cast(shape)
    return base.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce(spans, F.array().cast(shape)).alias("spans"))
