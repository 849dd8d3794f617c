"""Operators on documents against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF
from odd_rows import WORDS, none, odd  # noqa: F401
from wakeframe.llm import components, exact, licenses, lines, minhash, personal, phrase_index, quality, queries, sharding

ODD_ROWS = 13


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", k).group(1)) for k in queries.QUERIES} == set(range(1, 14))
    assert "pipeline" in entry.queries()


# --- personal data --------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(4)
    parts = ["a@b.co", "x.y+z@mail.example.org", "@", ".", "..", "1.2.3.4", "256.1.1.1", "300.1.2.3.4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "4111111111111111", "+1 (555) 123-4567", "+49", "+", "-", " ", "  ", "é", "😀", "000.001.002.0255", "a@b@c.de", "5.6", "٣", "\n", "9", "123456789012345678901"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "_", ", "]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in personal.find_spans(docs).collect():
        text = texts[r.doc_id]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain_spans(text)
        assert all(text[s.start : s.end] == s.value for s in r.spans)
        base = [(s.start, s.end) for s in r.spans if s.base]
        for s in r.spans:
            if not s.base:
                assert all(s.end <= a or s.start >= z for a, z in base)


def test_other_spans_are_added(spark):
    texts = [f"Please call me: phone ({200 + i}) 555-{1000 + i} today" for i in range(40)] + ["write to jane.roe [at] mail [dot] example [dot] com", "Dear Dr. Smith Jones, hello"]
    texts += [f"mail a{i}@b.org, from 10.0.0.{i} or +1 (555) 123-{1000 + i}" for i in range(60)]
    found = personal.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    values = {s.value for r in found for s in r.spans if not s.base}
    assert "(201) 555-1001" in values and len([v for v in values if "555" in v]) == 40


def planted(rng):
    """(text, planted value) of each kind beyond the base patterns, in sentences with and without a cue."""
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    first, last = rng.choice(personal.GIVEN_NAMES), rng.choice(["Smith", "Müller", "O'Neil", "Garcia-Lopez", "Dubois", "Novak", "Tanaka"])
    made = [
        ("set {} here", 'token = "%s"', hexed(40)), ("see {}", "%s", hexed(64)), ("use {} please", "api_key: %s", mixed(24)), ("the key {} works", "AKIA%s", "".join(rng.choice("ABCDEFGH234567") for _ in range(16))),
        ("push with {}", "ghp_%s", mixed(36)), ("login {} now", "password=%s", "x!" + mixed(9)), ("my {} ok", "Passwort: %s", mixed(7) + "#"),
        ("write to {}", "%s", f"{mixed(5)} [at] mail [dot] example [dot] com"), ("call {} today", "%s", f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        ("ssn {} given", "%s", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), ("iban {} thanks", "%s", f"DE{rng.randint(10, 99)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(10, 99)}"),
        ("dear Dr. {}, hello", "%s", None), ("we met {} there", "%s", f"{first} {last}"),
    ]
    frame, form, value = rng.choice(made)
    if value is None:
        value = f"Dr. {last}"
        return f"we saw {value}, hello", value
    if form.startswith("AKIA") or form.startswith("ghp"):
        value = form % value
        form = "%s"
    return frame.format(form % value), value


def test_recall_and_precision_of_added_spans(spark):
    rng = random.Random(21)
    decoys = ["version 10.2.3 of the model", "order 4412-99 page 12", "a token of thanks", "the password must be changed", "#aabbcc and 0x1f", "isbn 978-3-16-148410-0", "Paris and London",
              "the key point", "figure 3.14159", "serial AB12 CD34", "in 2024-10-12", "deadbeef", "room 555 1234"]
    rows, want = [], {}
    for k in range(1500):
        text, value = planted(rng) if k % 3 else (rng.choice(decoys), None)
        before, after = (" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 12))) for _ in range(2))
        rows.append((k, f"{before} {text} {after}"))
        if value:
            want[k] = value
    found = personal.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    added = {(r.doc_id, s.value.rstrip(".")) for r in found for s in r.spans if not s.base}
    true = {(k, v) for k, v in want.items()}
    recall, precision = len(true & added) / len(true), len(true & added) / len(added)
    print(f"recall {recall:.3f}, precision {precision:.3f}", sorted(true - added)[:5], sorted(added - true)[:5])
    assert recall >= 0.9 and precision >= 0.9


def test_no_length_is_cut(spark):
    long = "b" * 5000
    text = f"mail {long} [at] {long} [dot] com and token = {'0f' * 4000} and Dr. S{long} end " + "a." * 100_000 + " x" + "-a" * 100_000
    rows = [(k, text if not k else f"mail u{k} [at] h [dot] com, token = {'0f' * 20}, Dr. Smith") for k in range(40)]
    got = {r.doc_id: {s.value for s in r.spans} for r in personal.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), threshold=0.0).collect()}
    assert {f"{long} [at] {long} [dot] com", "0f" * 4000, f"Dr. S{long}"} <= got[0]


def test_estimated_reliability_follows_the_labelers():
    rng = random.Random(6)
    votes = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        draw = lambda right: (1 if truth else -1) if rng.random() < right else (-1 if truth else 1)  # noqa: B023, E731
        votes["email", (draw(0.95), draw(0.8), draw(0.7) if rng.random() < 0.5 else 0, draw(0.75), draw(0.5))] += 1
    chance, belief = personal.estimate([(k, v, n) for (k, v), n in votes.items()])
    good = [chance[j, 1][1] / (chance[j, 1][1] + chance[j, 1][-1]) for j in range(5)]
    assert good[0] > 0.9 and 0.72 < good[1] < 0.88 and good[0] > good[1] > good[4]
    assert belief["email", max(votes, key=votes.get)[1]] in (pytest.approx(0, abs=0.05), pytest.approx(1, abs=0.05))


def test_spans_of_odd_rows(odd, none):
    got = personal.find_spans(odd).collect()
    assert len(got) == ODD_ROWS and all(r.spans == [] for r in got)
    assert personal.find_spans(none).count() == 0


def test_long_runs_take_linear_time(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1.1." * 50_000 + " +" + "1 " * 100_000 + "9 ip 1.2.3.4 " + "a@b" * 50_000 + ".c.d" * 20_000
    (r,) = personal.find_spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    values = {s.value for s in r.spans if s.base}
    assert "1.2.3.4" in values and max(map(len, values)) > 80_000


# --- line dedup -----------------------------------------------------------------------------------


def test_lines_beyond_the_sketch_are_counted_exactly(spark):
    rows = [(i * 100 + s, f"own {i} {s}\nline {i}", f"site{s}") for i, n in enumerate([2, 299, 300, 301, 330, 900]) for s in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    got = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), min_sites=300).collect()
    gone = Counter(re.search(r"own (\d)", r.text).group(1) for r in got if r.n_removed)
    assert gone == {"2": 299, "3": 300, "4": 329, "5": 899}
    assert all(r.n_lines == 2 for r in got)


def test_lines_of_odd_rows(odd, none):
    got = lines.drop_boilerplate(odd, min_sites=2).collect()
    assert len(got) == ODD_ROWS and got[0].site == "x" and got[0].n_lines != "x"
    texts = Counter((r.doc_id, r.text) for r in got)
    assert texts[1, "plain words here\nshared line of several words"] == 2  # the smallest id keeps its line
    assert texts[None, "a text without an id"] == 1 and texts[None, None] == 1 and texts[3, ""] == 1 and texts[4, " \n\t \n"] == 1
    assert texts[9, "word"] == 0 and texts[9, ""] == 1
    assert {r.n_lines for r in got if r.text is None} == {0}
    assert lines.drop_boilerplate(none).count() == 0


def test_repeated_lines_stay_where_they_are_first(spark):
    rows = [(i, "same\nsame \n\nmine", f"s{i}") for i in range(12)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[0] == ("same\nsame \n\nmine", 4, 0)
    assert got[5] == ("", 4, 3)


# --- quality --------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op4(spark, "/root/testdata/sf0.01").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").collect()
    right = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert len(right) > 50 and np.mean(right) >= 0.95


def test_rules_say_what_they_score(spark):
    rules = quality.Rules(-1.0, (2.0, 0.5), ((("words", 1.0, float("inf")), ("upper", float("-inf"), 0.5)), (("digit", 0.1, 0.9),)))
    docs = spark.createDataFrame([("several lower words",), ("SHOUT",), ("1234 ab cd ef",), ("",), (None,)], "text string")
    got = [r.score for r in quality.score(docs, rules).collect()]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    assert got == pytest.approx([sigmoid(1), sigmoid(-1), sigmoid(1.5), sigmoid(-1), sigmoid(-1)])
    assert len(rules.lines()) == 2 and rules.lines()[0].startswith("+2.000")


def test_statistics_are_what_they_say(spark):
    text = "Ab cd cd é!\nX1 || #"
    (r,) = quality.with_statistics(spark.createDataFrame([(text,)], "text string")).collect()
    s = r.statistics
    assert (s.words, s.exclaim, s.bar, s.distinct_words) == pytest.approx((np.log1p(7), 1 / 19, 2 / 19, 6 / 7))
    assert (s.upper, s.digit, s.top_word, s.line_words) == pytest.approx((2 / 8, 1 / 19, 2 / 7, 3.5))


def test_quality_of_odd_rows(odd, none):
    labels = odd.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").union(odd.selectExpr("doc_id", "CAST(NULL AS INT)"))
    rules = quality.train(odd, labels)
    got = quality.score(odd, rules)
    assert got.columns == [*odd.columns, "score"]
    assert got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0 and got.count() == ODD_ROWS
    one = quality.train(odd, labels.filter("quality = 1"))
    assert one.weights == () and quality.score(odd, one).filter("score < 0.5").count() == 0
    assert quality.train(none, labels).intercept == 0.0
    assert quality.score(none, rules).count() == 0


# --- shards ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 100, 1009])
def test_permutation(spark, total):
    got = [r[0] for r in spark.range(total).select(sharding.permuted(F.col("id"), total, seed=3)).collect()]
    assert sorted(got) == list(range(total))
    if total > 50:
        assert got != sorted(got) and got != [r[0] for r in spark.range(total).select(sharding.permuted(F.col("id"), total, seed=4)).collect()]


def test_permutation_beyond_doubles(spark):
    total = 10**16 + 61
    numbers = [0, 1, total - 1, total // 2, 2**53 + 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").select(sharding.permuted(F.col("n"), total))
    got = [r[0] for r in df.collect()]
    assert len(set(got)) == 5 and all(0 <= x < total for x in got)


def test_op5_shards(spark):
    rows = queries.op5(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1 if raw else 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_do_not_depend_on_partitions(spark, odd, none):
    a = sharding.shard(odd, ["doc_id", "text"], 4).select("doc_id", "text", "shard", "slot", "id")
    b = sharding.shard(odd.repartition(7), ["doc_id", "text"], 4).select("doc_id", "text", "shard", "slot", "id")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.count() == ODD_ROWS and a.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert sharding.shard(none, ["doc_id"], 4).count() == 0


# --- exact groups ---------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [1000, 3])
def test_exact_groups(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    monkeypatch.setattr(exact, "SHARE", 1000)
    rng = random.Random(8)
    rows = [(i, rng.choice(["", None, "hot", "hot", "hot", f"t{rng.randint(0, 30)}", "x" * 200 + str(i % 3)])) for i in range(600)]
    got = {r.doc_id: r for r in exact.exact_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), keep=keep).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for i, t in rows:
        own = groups[t or ""]
        stays = min(own) if keep == "smallest" else max(own)
        assert tuple(got[i]) == (i, stays, len(own), i == stays, sha(t or ""))


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact_groups_of_odd_rows(odd, none, monkeypatch, hot):
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    monkeypatch.setattr(exact, "SHARE", 1000)
    got = exact.exact_groups(odd).collect()
    assert len(got) == ODD_ROWS
    stay = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stay.values()) == {1} and len(stay) == len({r.text_sha256 for r in got})
    assert {(r.keep_id, r.group_size) for r in got if r.text_sha256 == sha("")} == {(2, 3)}
    assert exact.exact_groups(none).count() == 0
    folded = exact.exact_groups(odd, normalise=lambda t: F.lower(F.btrim(t, F.lit(" \t\r\n"))))
    assert folded.filter("doc_id = 4").first().group_size == 4


# --- near copies ----------------------------------------------------------------------------------


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in sorted(sets.items()):
        shared = Counter(o for x in s for o in having[x])
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(i), find(o)))
                parent[b] = a
        for x in s:
            having[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_rows(seed, n):
    """Families of texts with a few words changed, so that similarities lie on both sides of the threshold."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 2, 3, 8, 25])):
            base = base if rng.random() < 0.5 else list(base)
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 9)}"
            rows.append((" ".join(own)).title() if rng.random() < 0.2 else " \n".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows[:n], 10))


@pytest.mark.parametrize("tile", [128, 3])
def test_near_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = near_rows(1, 700)
    want = plain_groups(rows)
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len({c for _, c in want.values()}) < 500


def test_op6_matches_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = queries.op6(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(rows)


def test_near_groups_of_odd_rows(odd, none):
    got = Counter(tuple(r) for r in minhash.near_groups(odd).collect())
    assert sum(got.values()) == ODD_ROWS
    assert got[1, 4, 1, True] == 2 and got[3, 0, 3, True] == 1 and got[4, 0, 4, True] == 1 and got[2, 0, 2, True] == 1
    assert got[None, 0, None, True] == 1 and got[9, 1, 8, False] == 1
    assert sum(n for (d, _, c, k), n in got.items() if d == 6 and c == 5 and not k) == 1
    assert minhash.near_groups(none).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(260, 259), (5, 5), (3, 4), (4, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(200, 261)}, 4: 3}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = minhash.signatures([np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))])
    assert abs((x == y).mean() - 0.75) < 0.16


# --- licenses -------------------------------------------------------------------------------------


def test_scan_finds_what_exact_windows_hold(spark):
    rng = random.Random(9)
    templates = [(f"t{k}", " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 30, 70, 200])]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, len(words) // 20)):
                words[rng.randrange(len(words))] = "changed"
            parts += [rng.choice(WORDS) for _ in range(rng.randint(0, 40))] + words
        rows.append((i, ", ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: {m.template_id for m in r.matches} for r in licenses.scan(df, spark.createDataFrame(templates, "template_id string, text string")).collect()}

    def grams(text, n):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    for i, text in rows:
        want = set()
        for name, t in templates:
            width = min(5, len(t.split()))
            own = set(grams(t, width))
            size = licenses.size_of(len(own))
            all_ = grams(text, width)
            if any(100 * len(own & set(all_[k : k + 2 * size])) >= 75 * len(own) for k in range(0, len(all_), size)):
                want.add(name)
        assert got[i] == want


def test_bands_keep_their_promise():
    for n in range(1, 300):
        s = licenses.least_similarity(n)
        assert 0 < s <= 1 and (1 - s) ** licenses.bands(s) <= licenses.MISS
    assert licenses.bands(0.5, rows=2) > licenses.bands(0.5)


def test_notices_cover_texts_headers_and_wordings(spark):
    gnu = "This {0} is free software; you can redistribute it and/or\n * modify it under the terms of the GNU {1} as published by\n * the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n// of this software and associated documentation files (the \"Software\"), to deal\n// in the Software without restriction, including without limitation the rights\n// to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n// copies of the Software, and to permit persons to whom the Software is\n// furnished to do so, subject to the following conditions:\n// The above copyright notice and this permission notice shall be included in\n// all copies or substantial portions of the Software.\n// THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n// IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n// FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\n// AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\n// LIABILITY": "mit:permission",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS": "isc-or-0bsd:permission",
        gnu.format("program", "General Public License", "2"): "gpl:terms gnu:version-2",
        gnu.format("library", "Lesser General Public License", "2.1"): "lgpl:terms gnu:version-2.1",
        gnu.format("program", "Affero General Public License", "3"): "agpl:terms gnu:version-3",
        "This is code licensed under the MIT License, see below": "mit:licensed",
        "SPDX-License-Identifier: MIT": "mit:spdx",
        "Available under the Apache License 2.0 since May": "apache-2.0:without-version",
        "You may use it under CC BY 4.0 as you like": "cc-by-4.0:short",
        "This is free and unencumbered software released into the public domain.": "unlicense:public-domain",
        "GNU Lesser General Public License v3.0": "lgpl-3.0:v",
        "Permission to land is granted to any person under the terms of the contract.": "",
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: {m.template_id for m in r.matches} for r in licenses.scan(rows, licenses.notices(spark)).collect()}
    for i, (text, want) in enumerate(texts.items()):
        assert set(want.split()) <= got[i] and bool(want) == bool(got[i]), (text, got[i])


def test_scan_of_odd_rows(spark, odd, none):
    templates = spark.createDataFrame([("a", "shared line of several words"), ("b", None), (None, "word"), ("c", ""), ("c", "plain words")], "template_id string, text string")
    got = licenses.scan(odd, templates).collect()
    assert len(got) == ODD_ROWS
    assert [[m.template_id for m in r.matches] for r in got if r.doc_id == 1] == [["a", "c"], ["a", "c"]] or sorted(m.template_id for m in got[0].matches) == ["a", "c"]
    assert [m.value for r in got if r.doc_id == 8 for m in r.matches] == ["word"]
    assert licenses.scan(none, templates).count() == 0 and licenses.scan(odd, templates.limit(0)).filter("size(matches) > 0").count() == 0


# --- benchmark phrases ----------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_phrases_and_proximity(spark):
    rng = random.Random(12)
    vocabulary = "a b c d e f".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 8])] + [(7, ""), (8, "zz yy"), (9, None)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = phrase_index.build_index(docs)
    names = {(r.segment, k): d.id for r in index.select("segment", "docs").collect() for k, d in enumerate(r.docs)}
    for slop in (0, 2):
        got = {(names[r.segment, r.doc], r.item_id): {(m.start, m.stop) for m in r.matches} for r in phrase_index.find_phrases(index, benchmark, width=4, slop=slop).collect()}
        for i, text in rows:
            words = plain_words(text)
            for k, item in items:
                own = plain_words(item)
                phrases = [own[a : a + 4] for a in range(max(1, len(own) - 3))] if own else []
                exact_hits = {(a, a + len(p)) for p in phrases for a in range(len(words) - len(p) + 1) if words[a : a + len(p)] == p}
                if slop == 0:
                    assert got.get((i, k), set()) == exact_hits
                    continue

                def near(p):
                    for a in range(len(words)):
                        at = a - 1
                        for w in p:
                            at = next((b for b in range(at + 1, len(words)) if words[b] == w), None)
                            if at is None:
                                break
                        if at is not None and words[a] == p[0] and at + 1 - a <= len(p) + slop:
                            return True
                    return False

                assert exact_hits <= got.get((i, k), set())
                assert bool(got.get((i, k))) == any(map(near, phrases))
                for a, z in got.get((i, k), set()):
                    assert any(z - a <= len(p) + slop and words[a] == p[0] and words[z - 1] == p[-1] for p in phrases)


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    docs, items = queries.table(spark, SF, "documents"), queries.table(spark, SF, "benchmark")
    whole = sorted(map(str, phrase_index.contamination(docs, items).withColumn("items", F.array_sort("items")).collect()))
    monkeypatch.setattr(phrase_index, "QUERY_WORDS", 400)
    monkeypatch.setattr(phrase_index, "SEGMENT_BYTES", 5000)
    assert sorted(map(str, phrase_index.contamination(docs, items).withColumn("items", F.array_sort("items")).collect())) == whole


def test_contamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "SHARED line, of several"), (1, "word"), (None, "another text"), (2, None), (3, "漢字")], "item_id bigint, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in phrase_index.contamination(odd, items).collect())
    assert sum(got.values()) == ODD_ROWS
    assert got[1, 8, 4, (1,), True] == 2 and got[8, 1, 1, (1,), True] == 1 and got[9, 6, 2, (), True] == 1 and got[None, 10, 4, (1,), True] == 1
    assert got[None, 0, 0, (), False] == 1 and got[3, 0, 0, (), False] == 1
    seven = odd.filter("doc_id = 7").first().text
    assert got[7, len(plain_words(seven)), 1, (3,), True] == 1
    assert phrase_index.contamination(none, items).count() == 0
    assert phrase_index.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark):
    docs = queries.table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.stored(stage(spark, now, SF), "test-stage")
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept[name] = {r.doc_id: r.text for r in now.collect()}
        had = {r.doc_id: r.text for r in before.collect()}
        assert kept[name].keys() <= had.keys()
        if name == "quality":
            assert np.mean([(d in kept[name]) == bool(q) for d, q in labels.items()]) > 0.95
        if name == "near copies":
            groups = plain_groups(list(had.items()))
            assert kept[name].keys() == {i for i, (_, c) in groups.items() if i == c}
        if name == "benchmark":
            clean = {r.doc_id for r in phrase_index.contamination(before, queries.table(spark, SF, "benchmark")).filter("NOT contaminated").collect()}
            assert kept[name].keys() == clean
        if name != "lines":
            assert all(had[d] == t for d, t in kept[name].items())
    placed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in placed.collect()} == kept["benchmark"].keys()


def test_stages_on_odd_rows(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars", "id", "n", "hash")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
