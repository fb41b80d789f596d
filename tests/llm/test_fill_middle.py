"""Boundary sets against sorted lists, and the transformation against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import fill_middle as fm
from plinth.llm import queries

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
LONG = "".join(random.Random(5).choice(["word", " ", "é", "漢", "\n", "x" * 70_000]) for _ in range(40)) + "語" * 100_000 + "ab" * 50_000
TEXTS = [None, "", "a", " ", "Hello, world!", "a<P>b", "x <S", "<", "<<P", "P>", "😀 ok\x00z é", "ab " * 30_000, "語" * 70_000, LONG]


@pytest.mark.parametrize("low", [[0], [65535], [5, 9, 70], range(0, 65536, 3), range(65536), [*range(10, 900), 4000, *range(9000, 30000)], sorted(random.Random(1).sample(range(65536), 20000)), sorted(random.Random(2).sample(range(65536), 4096))])
def test_containers_select(low):
    low = np.array(list(low))
    for kind in (fm.ArrayContainer, fm.BitmapContainer, fm.RunContainer, fm.container):
        c = kind(low)
        for k in {0, len(low) - 1, len(low) // 2, len(low) // 3, *random.Random(3).sample(range(len(low)), min(20, len(low)))}:
            assert c.select(k) == low[k]
    smallest = {len(range(65536)): fm.RunContainer, 4096: fm.ArrayContainer, 20000: fm.BitmapContainer}
    if len(low) in smallest:
        assert type(fm.container(low)) is smallest[len(low)]


def _plain(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fm.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_a_plain_version(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS * 8)] + [(None, "no id", "x"), (3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    out = fm.fill_middle(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    want = sorted([(k, *_plain(k, t), t or "") for k, t, _ in rows], key=key)
    assert sorted([tuple(r) for r in out], key=key) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fm.fill_middle(df.limit(0)).count() == 0


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_fill_middle"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, form, p, m, output = _plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
