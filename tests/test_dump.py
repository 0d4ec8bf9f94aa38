"""Dumps whose texts, statements and blocks run over lines and file splits."""

import pytest
from pyspark.errors import PySparkException

from martlet import sources

# Own sample with texts over several lines, many rows in a statement, listed columns, comments and COPY blocks.
DUMP = r"""-- it's a comment
CREATE TABLE shippers (shipper_id smallint, name varchar(40));
INSERT INTO shippers VALUES (1, 'two
lines', NULL), (2, 'INSERT INTO orders VALUES (1);
it''s (not) a row; -- no comment

', '5'), -- don't
  (3,
   'c', NULL)
;
INSERT INTO public.shippers (phone, shipper_id) VALUES
  ('1-2', 4),

  ('', 5);
insert into "shippers" values (6, '', null); INSERT INTO region VALUES (1, 'a;b'), (2, ''''); INSERT INTO shippers VALUES (7, ',', ')')
ON CONFLICT DO NOTHING;
COPY public.shippers (shipper_id, company_name, phone) FROM stdin;
8<TAB>it's -- (open<TAB>\N
9<TAB>back\\slash\ttab\nline<TAB>\\N
10<TAB><TAB>;
\.
COPY region FROM stdin;
3<TAB>Insert INTO shippers VALUES (1
\.
INSERT INTO shippers VALUES (11, 'last', 'x');
""".replace("<TAB>", "\t")

SHIPPERS = [
    (1, "two\nlines", None),
    (2, "INSERT INTO orders VALUES (1);\nit's (not) a row; -- no comment\n\n", "5"),
    (3, "c", None),
    (4, None, "1-2"),
    (5, None, ""),
    (6, "", None),
    (7, ",", ")"),
    (8, "it's -- (open", None),
    (9, "back\\slash\ttab\nline", "\\N"),
    (10, "", ";"),
    (11, "last", "x"),
]
REGIONS = [(1, "a;b"), (2, "'"), (3, "Insert INTO shippers VALUES (1")]


def loaded(tables, name):
    return sorted(tuple(r) for r in tables[name].collect())


@pytest.fixture
def split_bytes(spark, request):
    """File splits of so many bytes."""
    settings = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split_bytes, line_end", [(16, "\n"), (61, "\r\n"), (1 << 20, "\n")], indirect=["split_bytes"])
def test_one_file_in_many_splits(spark, tmp_path, split_bytes, line_end):
    folder = tmp_path / "dumps"
    folder.mkdir()
    (folder / "a.sql").write_bytes(DUMP.replace("\n", line_end).encode())
    (folder / "b.sql").write_text("INSERT INTO shippers VALUES (12, 'other\nfile', NULL);")
    (folder / "c.sql").write_text("")
    tables = sources.read_dump(spark, str(folder))
    want = [(a, b and (b if a == 9 else b.replace("\n", line_end)), c) for a, b, c in SHIPPERS]
    assert loaded(tables, "shippers") == [*want, (12, "other\nfile", None)]
    assert loaded(tables, "region") == REGIONS


def test_convert_a_dump_with_blocks(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text(DUMP)
    counts = sources.convert_dump(spark, str(path), str(tmp_path / "out"))
    assert counts["shippers"] == len(SHIPPERS) and counts["region"] == len(REGIONS)
    tables = sources.read_tables(spark, str(tmp_path / "out"))
    assert loaded(tables, "shippers") == SHIPPERS and loaded(tables, "region") == REGIONS


@pytest.mark.parametrize("split_bytes", [200], indirect=True)
def test_a_statement_of_many_rows(spark, tmp_path, split_bytes):
    path = tmp_path / "d.sql"
    path.write_text("INSERT INTO shippers VALUES\n" + ",\n".join(f"({i}, 'name\n{i}', NULL)" for i in range(300)) + ";\n")
    assert loaded(sources.read_dump(spark, str(path)), "shippers") == [(i, f"name\n{i}", None) for i in range(300)]


@pytest.mark.parametrize(
    "text",
    [
        "INSERT INTO shippers VALUES (1, 'no end, NULL);",
        "INSERT INTO shippers VALUES (1, 'a'::text, NULL), (2, 'a' 'b', lower('A'));",
        "INSERT INTO shippers VALUES (1, 'a', NULL) RETURNING 1;",
        "INSERT INTO shippers (shipper_id, colour) VALUES (1, 'red');",
        "INSERT INTO shippers SELECT 1, 'a', NULL;",
        "COPY shippers FROM stdin;\n1\ta\t\\N",
        "COPY shippers FROM stdin;\n1\ta\\qb\t\\N\n\\.",
        "COPY shippers FROM stdin WITH (FORMAT csv);\n1,a,\n\\.",
        "INSERT INTO shippers VALUES (1, '\nCOPY shippers FROM stdin;\n\\.\n', NULL);",
        "COPY shippers FROM stdin;\nCOPY region FROM stdin;\n\\.",
    ],
)
def test_what_cannot_be_read_fails(spark, tmp_path, text):
    path = tmp_path / "d.sql"
    path.write_text(f"INSERT INTO shippers VALUES (7, 'x', NULL);\n{text}\n")
    with pytest.raises(PySparkException):
        sources.read_dump(spark, str(path))["shippers"].collect()
