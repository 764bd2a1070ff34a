"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: operators and stages."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import chat_format, decontaminate, exact_dedup, html_extract, jaccard, packing, pii, sharding, substring_dedup, toxicity

_words = random.Random(29)
VOCAB = ["".join(_words.choices("abcdefghijklmnop", k=_words.randint(2, 7))) for _ in range(400)]
#: Names that the operators use inside.
CLASH = ["uid", "place", "tokens", "kept", "n", "size", "s0", "h", "p", "x", "fp", "part", "salt", "_salt", "count", "token", "score", "id", "row", "span", "own", "ents", "shard", "bin", "pieces", "path", "host", "window", "window_start"]


def prose(n):
    return " ".join(_words.choices(VOCAB, k=n))


LONG = prose(30_000)
ITEM = prose(20)
HELD = f"{prose(10)} {ITEM} {prose(9)}"
ROWS = [
    (1, prose(80)), (2, None), (3, ""), (4, "   \n\t "), (5, "one"), (5, "one"), (5, "another text"), (None, None), (None, "no id"), (None, "no id"),
    (6, LONG), (7, LONG + " end"), (8, HELD), (8, HELD), (9, "Mr Smith writes to a@b.org"), (10, ITEM), (11, ITEM), (-3, "x" * 30_000),
]
TEXTS = "doc_id long, text string"


def tables(spark):
    return {
        "docs": spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in ROWS], f"{TEXTS}, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, ITEM), (None, ITEM), (5, "two words")], "item_id long, text string"),
        "labels": spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)] + [(None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://h/1", "<p>a</p>"), (1, "http://h/1", "<p>a</p>"), (2, None, None), (None, "", ""), (3, "x", "<<<>>&amp;&#0;</p></p><p"), (4, "http://h/2", f"<article><p>{LONG}</p></article>")], "page_id long, url string, html string"),
        "turns": spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", LONG), (1, 2, None, None), (None, None, None, None), (2, 5, "assistant", "</s>[ROLE=x]&amp;")], "conv_id long, turn long, role string, text string"),
    }


CALLS = {
    "op1": lambda t: sharding.kd_shards(t["docs"], shards=4).select("doc_id", "size", "text_crc32", "law"),
    "op2": lambda t: chat_format.digests(chat_format.windows(t["turns"])),
    "op3": lambda t: substring_dedup.repeated_passages(t["docs"]),
    "op4": lambda t: pii.pseudonymize(t["docs"]),
    "op5": lambda t: packing.pack_documents(t["docs"]).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op6": lambda t: exact_dedup.exact_groups(t["docs"]).select("doc_id", "keep_id", "group_size", "text_sha256"),
    "op7": lambda t: decontaminate.contaminated(t["docs"], t["benchmark"]),
    "op8": lambda t: html_extract.extract(t["pages"]),
    "op9": lambda t: toxicity.scores(t["docs"], toxicity.fit(t["docs"], t["labels"])),
    "op10": lambda t: jaccard.jaccard_components(t["docs"]),
}


def counted(df):
    return collections.Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def plain(spark):
    t = tables(spark)
    return {k: counted(f(t)) for k, f in CALLS.items()}


@pytest.mark.parametrize("op", CALLS)
def test_clashing_names_change_nothing(spark, plain, op):
    t = {k: df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns}) for k, df in tables(spark).items()}
    assert counted(CALLS[op](t)) == plain[op]


@pytest.mark.parametrize("op", CALLS)
def test_empty_tables_give_empty_results(spark, op):
    t = {k: df.limit(0) for k, df in tables(spark).items()}
    assert CALLS[op](t).count() == 0


@pytest.mark.parametrize("op", ["op7", "op9"])
def test_an_empty_second_table(spark, op):
    t = tables(spark)
    t |= {"benchmark": t["benchmark"].limit(0), "labels": t["labels"].limit(0)}
    got = CALLS[op](t).collect()
    assert not got if op == "op7" else len(got) == len(ROWS) and all(r.score < 0.3 for r in got)


def test_a_row_per_row(plain):
    for op in ("op1", "op4", "op6", "op9", "op10"):
        assert sum(plain[op].values()) == len(ROWS), op
    assert sum(plain["op8"].values()) == 6


def test_repeated_rows_are_treated_alike(plain):
    for op in ("op1", "op4", "op6", "op9", "op10"):
        assert all(n % 2 == 0 for r, n in plain[op].items() if r[0] == 8 or (r[0] is None and "no id" in r)), op


def test_long_texts_are_read_whole(plain):
    assert {r[0] for r in plain["op3"] if r[2] >= 29_000} == {6, 7}
    assert {r[:2] for r in plain["op6"] if r[0] in (6, 7)} == {(6, 6), (7, 7)}
    assert {r[2] for r in plain["op10"] if r[0] in (6, 7)} == {6}
    assert len(LONG) in {r[3] for r in plain["op8"]}
    pieces = [r for r in plain["op5"] if r[0] == 6]
    assert max(r[2] + r[3] for r in pieces) == sum(r[3] for r in pieces) > 30_000


def test_nulls_and_ties(plain):
    assert {(r[0], r[1]) for r in plain["op7"]} == {(d, i) for d in (8, 10, 11) for i in (1, 4)}
    assert all(r[1] is None for r in plain["op4"] if r[0] == 2) and all(r[1] == "" for r in plain["op4"] if r[0] == 3)
    keep = {r[0]: r[1] for r in plain["op6"]}
    assert keep[10] == keep[11] == 11 and keep[2] == keep[3] == 3
    assert {r[0]: r[2] for r in plain["op10"] if r[0] in (2, 3, 4, 10, 11)} == {2: 2, 3: 3, 4: 4, 10: 10, 11: 10}
    assert {r[0] for r in plain["op2"]} == {None, 1, 2}


def test_votes_that_tie_are_the_same_however_pages_are_dealt(spark):
    rows = [(k, "http://h/x", f"<body><div class='{'ab'[k % 2]}'><p>{'word ' * 20}</p></div></body>") for k in range(6)]
    got = {counted(html_extract.host_paths(spark.createDataFrame(rows[::d], "page_id long, url string, html string").repartition(n)).select("path")).most_common(1)[0][0] for d, n in ((1, 1), (-1, 5))}
    assert len(got) == 1


# stages of the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    r = random.Random(5)
    rows = [(i, f"{prose(r.randint(20, 90))} {'zorgfool' if i % 9 == 0 else ''} {prose(4)}") for i in range(700)]
    text = dict(rows)
    rows += [(1000 + i, text[i * 3 + 1]) for i in range(30)] + [(1100 + i, text[i * 3 + 1].upper()) for i in range(10)]  # copies
    rows += [(1200 + i, f"{prose(12)} {ITEM} {prose(14)}") for i in range(8)] + [(2000, None), (2001, ""), (2002, LONG), (2003, LONG + " more"), (None, "a row without an id"), (2004, "twice"), (2004, "twice")]
    base = prose(100).split()
    for i in range(20):  # near copies
        w = list(base)
        w[(i * 5) % 100] = "changed"
        rows.append((1300 + i, " ".join(w)))
    docs = spark.createDataFrame([(*x, "en", "s", len(x[1] or "")) for x in rows], f"{TEXTS}, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(700) if i % 5], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, prose(25))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def shingle_set(text, width=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_each_stage_against_brute_force(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, at)
    assert clean.columns == docs.columns
    got = kept(clean)
    assert all(bool(got[i, t]) == (i is None or i >= 700 or "zorgfool" not in t) for i, t in rows)

    once = kept(corpus_pipeline.drop_copies(spark, docs, at))
    best = {}
    for i, t in rows:
        key = (t or "").lower()
        best[key] = max(best.get(key, (-(1 << 63))), i if i is not None else -(1 << 62))
    assert sum(once.values()) == len(best) and all(once[i, t] == 1 for i, t in rows if i is not None and best[(t or "").lower()] == i)

    near = kept(corpus_pipeline.drop_near_copies(spark, docs, at))
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and len(s & t) * 100 >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = {i for i, _ in sets if root(i) == i}
    assert {i for i, _ in near} - {None} == want and near[None, "a row without an id"] == 1 and near[2004, "twice"] == 1

    told = kept(corpus_pipeline.drop_benchmark(spark, docs, at))
    assert {i for i, _ in rows} - {i for i, _ in told} == set(range(1200, 1208))


def test_the_whole_pipeline(spark, folder):
    at, rows = folder
    out = corpus_pipeline.run(spark, at)
    ids = {r.doc_id for r in out.collect()}
    assert not ids & set(range(1200, 1208)) and not ids & {i for i in range(0, 700, 9)}
    assert len(ids & set(range(1300, 1320))) == 1 and len(ids & {2002, 2003}) == 1 and {2004, None} <= ids
    held = collections.defaultdict(list)
    for r in out.collect():
        held[r.sequence_id].append(r.length)
    assert all(sum(b) <= 2048 for b in held.values())


def test_stages_on_empty_tables(spark, folder, tmp_path):
    at, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns), name


def test_stages_keep_extra_columns(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumns({c: F.lit(7) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns, name
