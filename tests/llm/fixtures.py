"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import duckdb

SF = "/root/testdata/sf0.001"


def texts(limit=60):
    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {limit}").fetchall()]


def hard_documents(spark):
    base = texts(25)
    long = " ".join(random.Random(1).choice(base[0].split()) for _ in range(60_000))
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", None, 4), (103, long, "de", "src1", len(long)), (104, base[3], "en", "src1", 1), (105, base[3], "en", "src1", 1)]
    rows += [(106, "word", "en", "src0", 4), (107, "漢字かな交じり文" * 50, "ja", "src0", 400), (108, "a\x1cb\x85c\xa0d <|endoftext|> İΣ '\u0301'", "en", "src0", 9)]
    rows += [(None, "no id", "en", "src0", 5), (7, base[7], "en", "src1", len(base[7]))]
    clash = [(*r, "x", 1, 2.0, "y", "z") for r in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, score double, d string, fingerprint string"
    return spark.createDataFrame(clash, names), rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
