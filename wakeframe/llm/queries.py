"""One query for each operator, over the whole of its tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeframe.llm import (
    divergence,
    exact,
    interaction,
    licenses,
    lines,
    minhash,
    packed_ids,
    packing,
    personal,
    phrase_index,
    quality,
    sharding,
    tokens,
    url_filter,
)
from wakeframe.session import scratch

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers  # only the token operators need it

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packed_ids")
def op1(spark, sf_dir):
    """Ids of all documents through bit-packed files and back."""
    path, folder = vocabulary(), scratch(spark, "ids")
    packed_ids.write_texts(packed_ids.in_order(table(spark, sf_dir, "documents")), folder, path)
    return packed_ids.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SEQUENCE = 2048


def packed(docs: DataFrame) -> DataFrame:
    pieces = tokens.tokenize(docs, vocabulary(), max_length=SEQUENCE)
    items = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(items, SEQUENCE, ["doc_id", "piece"], carry=["start", "ids_crc32"])


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))


@query(
    "op3_line_spread",
    f"""
    WITH l AS (
        SELECT doc_id, coalesce('s' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL
    ), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l), b AS (
        SELECT key, min(doc_id) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= {lines.MIN_SITES}
    ), m AS (
        SELECT k.doc_id, k.pos, k.line, (b.key IS NOT NULL AND k.doc_id <> b.first) AS gone FROM k LEFT JOIN b USING (key)
    ), t AS (
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
        FROM m GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(t.text, '')) AS text_sha256
    FROM (SELECT doc_id FROM documents) LEFT JOIN t USING (doc_id)
    """,
)
def op3(spark, sf_dir):
    """Documents without the lines that ten or more sources share."""
    cleaned = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


SHARDS = 8


@query("op5_feistel_shards")
def op5(spark, sf_dir):
    """All documents in eight shards whose row counts differ by one at most. No groups: copies are dealt singly."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op9_exact_groups",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op9(spark, sf_dir):
    """Groups of equal texts; the largest id stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def _words_sql(source: str, key: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT {key}, {words} AS w FROM {source}"


@query(
    "op8_phrase_index",
    f"""
    WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
    phrases AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), sizes AS (SELECT DISTINCT n FROM phrases), runs AS (
        SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)
    ), hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN phrases USING (n, phrase)), words AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op8(spark, sf_dir):
    """Words of all documents that lie in ten-word phrases of the benchmark."""
    found = phrase_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


@query("op6_minhash_groups")
def op6(spark, sf_dir):
    """Groups of near copies among all documents; the smallest id stays."""
    return minhash.near_groups(table(spark, sf_dir, "documents"))


KEEP_SCORE = 0.7


def held_out():
    """Rows that no classifier learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query("op4_quality_rules")
def op4(spark, sf_dir):
    """Quality of all documents by rules learnt from three quarters of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = quality.train(docs, labels.filter(~held_out()))
    scored = quality.score(docs.select("doc_id", "text"), rules)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


@query("op2_personal_spans")
def op2(spark, sf_dir):
    """Personal data in all documents: base spans, and those that the classifier adds."""
    found = personal.find_spans(table(spark, sf_dir, "documents"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in personal.BASE]
    digest = F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.array_join(F.transform("spans", place), ",").alias("spans"))


def _license_sql() -> str:
    """Containment in every window, without sketches: the windows and sets that the operator defines."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    values = ", ".join(f"('{k}', '{v}')" for k, v in licenses.NOTICES.items())
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH t AS (SELECT template_id, {words} AS w FROM (VALUES {values}) AS v(template_id, text)),
    s AS (
        SELECT DISTINCT template_id, n, array_to_string(w[i : i + n - 1], ' ') AS shingle
        FROM (SELECT template_id, w, least(len(w), {licenses.WORDS}) AS n, unnest(range(1, greatest(len(w) - {licenses.WORDS - 1}, 1) + 1)) AS i FROM t)
    ), sizes AS (
        SELECT template_id, count(*) AS total, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM s GROUP BY template_id
    ), d AS (SELECT doc_id, {words} AS w FROM documents), runs AS (
        SELECT doc_id, n, i - 1 AS pos, array_to_string(w[i : i + n - 1], ' ') AS shingle
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM s) ON len(w) >= n)
    ), found AS (
        SELECT doc_id, template_id, total, shingle, pos // size - back AS win
        FROM runs JOIN s USING (n, shingle) JOIN sizes USING (template_id), (VALUES (0), (1)) AS b(back)
    ), good AS (
        SELECT doc_id, template_id FROM found WHERE win >= 0 GROUP BY doc_id, template_id, win
        HAVING 100 * count(DISTINCT shingle) >= {licenses.PERCENT} * any_value(total)
    ), listed AS (
        SELECT doc_id, count(*) AS n_licenses, string_agg(template_id, ',' ORDER BY template_id) AS licenses
        FROM (SELECT DISTINCT * FROM good) GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN listed USING (doc_id)
    """


@query("op7_license_scan", _license_sql())
def op7(spark, sf_dir):
    """License notices that each document holds."""
    found = licenses.scan(table(spark, sf_dir, "documents"), licenses.notices(spark))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template_id"])))
    return found.select("doc_id", F.size(names).cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


@query(
    "op11_source_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    w AS (
        SELECT id, lang, source,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM d
    ), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.MIN_DOCS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS size FROM kept GROUP BY lang),
    g AS (
        SELECT lang, source, any_value(coalesce(size, 0)) AS size, coalesce(sum(n), 0) + any_value(coalesce(size, 0)) AS total
        FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source
    ), p AS (
        SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // total AS p
        FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), l AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(size) + any_value(total)) AS q
        FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        UNION ALL
        SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.size = 0
    ), terms AS (
        SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
    ), listed AS (
        SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
    )
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM listed)
    WHERE part = 'pair' OR rank <= {divergence.TOP}
    """,
)
def op11(spark, sf_dir):
    """How far each source of a language is from the others, and the words that set it apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


RULES = [
    url_filter.Rule("block", "net/"),
    url_filter.Rule("allow", "example.net/en/"),
    url_filter.Rule("block", "example.com/de/"),
    url_filter.Rule("allow", "org/fr/"),
]


@query("op12_url_filter")
def op12(spark, sf_dir):
    """Every page's URL, blocked or allowed: by the rules, else by a model of a small labelled table of URLs."""
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES, url_filter.train(labelled))


def _interaction_sql() -> str:
    names = interaction.FILTERS
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(names))
    steps = range(1, len(names) + 1)
    chosen = ", ".join(f"o{k}.f AS f{k}, o{k}.bit AS b{k}" for k in steps)
    joined = " ".join(f"JOIN f o{k} ON {' AND '.join(f'o{k}.bit <> o{j}.bit' for j in range(1, k))}" for k in steps if k > 1)
    each = " UNION ALL ".join(
        f"SELECT {' || '.join(f'f{k}' for k in steps)} AS filter_order, {s} AS step, {' + '.join(['0', *[f'b{k}' for k in range(1, s)]])} AS state, b{s} AS bit FROM orders"
        for s in steps
    )
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    x AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    m AS (
        SELECT doc_id, part,
               CASE WHEN len(w) < {interaction.MIN_WORDS} THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(w)) < {interaction.DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
               + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {interaction.UPPER_PERCENT} * length(text) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
        FROM x
    ), marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INTEGER)) AS good, max(CAST(coalesce(toxic = 1, false) AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    cells AS (
        SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN marks USING (doc_id) GROUP BY part, mask
    ), f AS (SELECT * FROM (VALUES {letters}) AS t(f, bit)), orders AS (SELECT {chosen} FROM f o1 {joined}), steps AS ({each}),
    parts AS (
        SELECT part, filter_order, step, bit,
               CAST(coalesce(sum(n) FILTER (mask & (state | bit) = 0), 0) AS BIGINT) AS kept,
               CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & state = 0), 0) AS BIGINT) AS removed,
               CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & state <> 0), 0) AS BIGINT) AS redundant,
               CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & state = 0), 0) AS BIGINT) AS good_lost,
               CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & state = 0), 0) AS BIGINT) AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM parts
    """


@query("op13_filter_interaction", _interaction_sql())
def op13(spark, sf_dir):
    """What five filters remove from all documents in each of their 120 orders."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
