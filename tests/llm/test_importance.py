"""Importance resampling against plain Python and its SQL."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import importance as m

LONG = " ".join(f"Word{i % 400} über{i % 90}" for i in range(30_000))
TEXTS = [
    None, "", " \n\t.,!", "a b c", "Hello, WORLD 12-34 hello", "É é ß x\x00y\x7fz [ ] ^ _ ` { | } ~", LONG, "plain words " * 15, "plain words " * 15, "the target talks of this " * 8, "the target talks of this " * 8,
    " ".join(f"rare{i}" for i in range(60)), " ".join(f"rare{i}" for i in range(40)),
]
TARGETS = ["the target talks of this and that", None, "", "The TARGET, of this!"]


def plain(docs, targets, n=1, buckets=m.BUCKETS, min_words=20, percent=10):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for f in found for b in f[2]), Counter(b for x in targets for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= min_words))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {}
    for k, r in enumerate(order[: len(order) * percent // 100], 1):
        drawn.setdefault(r[:4], []).append(k)
    return sorted(((*r[:4], drawn[r[:4]].pop(0) if drawn.get(r[:4]) else None) for r in rows), key=repr)


@pytest.mark.parametrize("n,percent", [(1, 10), (1, 50), (3, 100), (2, 0)])
def test_equal_to_plain_python(spark, n, percent):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[8]), (None, TEXTS[8]), (9, TEXTS[9]), (9, TEXTS[9])]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, bucket string, row int, rank int").repartition(5)
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGETS)], "item_id long, text string")
    got = [tuple(r) for r in m.resampled(df, target, n=n, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == plain(docs, TARGETS, n, percent=percent)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert m.resampled(none, docs).collect() == []
    assert [tuple(r) for r in m.resampled(docs, none, percent=100).collect()] == plain([(1, "a " * 30)], [], percent=100)


def test_ranks_over_many_ranges(spark):
    docs = [(i % 97, f"w{i % 5} " * 25) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        got = m.resampled(df, df.limit(3), percent=40).select("doc_id", "n_features", "weight", "score", "rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, got), key=repr) == plain(docs, [t for _, t in docs[:3]], percent=40)


def test_equal_to_sql(spark, sf_dir):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["op11_importance"])
    names = [d[0] for d in want.description]
    df = entry.queries()["op11_importance"](spark, sf_dir)
    assert df.columns == names and {t for _, t in df.dtypes} == {"bigint"}
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = m.weighed(docs, docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 25, {"k": i}) for i in range(20)] + [(None, "y " * 30, None)], "doc_id long, text string, rank map<string,int>")
    got = m.drawn_documents(docs, docs, percent=50).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 11)) and all(r["row"]["text"].startswith(f"w{r['row']['doc_id']} ") for r in got if r["row"]["doc_id"] is not None)


def test_gumbel_of_null(spark):
    row = spark.range(1).select(m.gumbel(F.lit(None).cast("long")).alias("g")).first()
    h = int(sha256(b"2024:").hexdigest()[:8], 16)
    assert row["g"] == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
