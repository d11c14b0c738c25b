"""Names with quotes, dots and back quotes, and an entry without its optional part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from goldpan.operators.audit import NULL_COUNT, column_audit, column_dictionary, row_counts
from goldpan.plans.star import Entry

ODD = ["it's", "a.b", "odd `name", "the key", 'say "x"']


def test_audits_of_odd_names(spark):
    names = ", ".join(f"`{n.replace('`', '``')}` string" for n in ODD)
    df = spark.createDataFrame([("x", None, "abc", None, None), ("y", "z", None, None, "é")], names)
    found = {r["column"]: r["n"] for r in column_audit(df, ODD, NULL_COUNT, "column", "n").collect()}
    assert found == dict(zip(ODD, [0, 1, 1, 2, 1]))
    rows = column_dictionary(df, "it's", "o'clock").collect()
    assert [(r["schema_name"], r["object_name"], r["column_name"]) for r in rows] == [
        ("it's", "o'clock", n) for n in ODD
    ]
    assert [(r["max_length"], r["null_count"], r["col_position"]) for r in rows] == [
        (1, 0, 1), (1, 1, 2), (3, 1, 3), (None, 2, 4), (1, 1, 5),
    ]
    counted = row_counts([Entry("it's", "a'b", "VIEW", df), Entry("x", "none", "VIEW", df.limit(0))])
    assert sorted(map(tuple, counted.collect())) == [("it's", "a'b", "VIEW", 5, 2), ("x", "none", "VIEW", 5, 0)]


def test_entry_without_a_library_of_the_optional_part():
    """Where an optional library is missing, the exploration queries stay."""
    code = (
        "import sys; sys.modules['xxhash'] = None; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as c\n"
        "assert c.llm is None and len(c.queries()) == len(c.oracle_sql()) > 70\n"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
