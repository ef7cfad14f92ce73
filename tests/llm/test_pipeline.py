"""The pipeline against a brute-force version of its first three stages and a check of its packing."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm.queries import oracle_sql, queries, vocabulary

from test_operators import brute_components, brute_measures, brute_spans

SF = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, _, repeated = brute_measures(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    doubled = len(lines) - len(set(lines))
    return not (n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 100 * doubled > 30 * len(lines) or chars > 10 * n)


def masked(text):
    out, at = "", 0
    for start, _, end in brute_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [r for r in rows if passes(r[1])]
    keep = {c for _, _, c in brute_components(rows)}
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for i, t in rows:
        if i in keep:
            ids = np.array(tok.encode(masked(t), add_special_tokens=False).ids + [0], "<u4")
            first = (len(ids) - 1) % 2048 + 1
            cuts = [0, *range(first, len(ids), 2048), len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "best_fit_packing"]


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, other columns with clashing names, no rows."""
    clean = " ".join(f"word{i} and" for i in range(40))
    rows = [
        (1, clean, "en", "s", 5, "x"), (1, clean, "en", "s", 5, "x"), (None, clean, None, None, None, None), (2, clean + " tail", "en", None, 7, "y"), (3, None, "en", "s", 0, "z"), (4, "", "en", "s", 0, "z"),
        (5, " ".join(f"long{i}" for i in range(60_000)), "en", "s", 9, "w"), (None, None, None, None, None, None), (6, " ".join(f"other{i} is" for i in range(30)) + " password: hunter22", "en", "s", 1, "v"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumn("row", F.lit(1)).withColumn("uid", F.lit(2)).withColumn("failed", F.lit(None).cast("string"))
    df.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == df.columns, name
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.count() == 3 and set(got) == {1, 5, 6} and got[6].endswith("[SECRET]")
    packed = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {1, 5, 6}
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
