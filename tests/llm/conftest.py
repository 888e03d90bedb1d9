from __future__ import annotations

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, shard string, `group` string, node string, t string, blob string, `a.b` string, `we``ird name` string, __p string, __k string, __part string, __pool string, __hash string, __gone string, __left string, __t string, "
COLUMNS += "__blob string, __row string, `row` string, doc string, copy string, salt string, least string, mark string, position string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, many equal rows without an id, and columns with dots or named like the
    operators' own."""
    prose = " ".join(f"word{i} the w{i}b of v{i}c" for i in range(30))
    long = "\n".join(f"line{i} the x{i}a of y{i}b and z{i}c is u{i}d" for i in range(6000))
    more = [f"own{i}" for i in range(COLUMNS.count(", ") + 1 - 5)]
    rows = [
        (1, prose, "en", "src0", len(prose)), (1, prose, "en", "src0", len(prose)), (2, prose, "en", "src0", len(prose)), (3, None, "en", "src1", None), (4, "", None, None, 0), (5, " \n\t ", "de", "nowhere", 4),
        (6, long, "fr", "src2", len(long)), (None, "an id of null and the text is here", "en", "src3", 1), (None, None, None, None, None), (7, "one two", "en", "src0", 7), (8, "one two", "en", "src0", 7),
        (9, "Tab\x0bvertical   no-break   separator Ünïcode 漢字 🙂", "en", "src5", 1), (7, "same id, other text", "es", "src0", 3),
    ]
    rows += [(None, "a text that stands many times and has no id at all", "en", "src0", 9)] * 300
    return spark.createDataFrame([(*r, *more) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
