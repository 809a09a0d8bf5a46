import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from datumloom.sources import dumps

CREATE = "-- Table orders\nCREATE TABLE orders (id int PRIMARY KEY, note text);\n"


def rows(spark, folder, text):
    folder.mkdir(exist_ok=True)
    (folder / "dump.sql").write_bytes(text.encode())
    return sorted((r.id, r.note) for r in dumps.read_dump(spark, str(folder))["orders"].collect())


def test_insert_after_comments(spark, tmp_path):
    text = CREATE + "\n-- Bob's data (for orders);\n/* more;\nlines */ INSERT INTO orders (id, note) VALUES (1, 'a');\n-- last\nINSERT INTO orders VALUES (2, NULL);\n-- end\n"
    assert rows(spark, tmp_path / "d", text) == [(1, "a"), (2, None)]


def test_both_line_ends(spark, tmp_path):
    text = CREATE + "INSERT INTO orders (id, note) VALUES (1, 'a'),\n(2, 'b');\nINSERT INTO orders (id, note) VALUES (3, 'c; d');\n"
    want = [(1, "a"), (2, "b"), (3, "c; d")]
    assert rows(spark, tmp_path / "lf", text) == want
    assert rows(spark, tmp_path / "crlf", text.replace("\n", "\r\n")) == want
    head, tail = text.split("INSERT", 1)
    assert rows(spark, tmp_path / "mixed", head + ("INSERT" + tail).replace("\n", "\r\n")) == want


def test_semicolons_at_line_ends_in_texts(spark, tmp_path):
    text = CREATE + "INSERT INTO orders (id, note) VALUES (1, 'it''s;\nINSERT INTO orders VALUES (9, 0);\r\nx');\nINSERT INTO orders (id, note) VALUES (2, 'b');\n"
    assert rows(spark, tmp_path / "d", text) == [(1, "it's;\nINSERT INTO orders VALUES (9, 0);\r\nx"), (2, "b")]


def test_line_ends_are_written_and_read_again(spark, tmp_path):
    want = [(1, "a;\nb"), (2, "it's \\n;\r\n'"), (3, "plain \\ text"), (4, None), (5, "")]
    dumps.write_dump(spark.createDataFrame(want, "id int, note string"), "orders", f"{tmp_path}/d/rows")
    (tmp_path / "d" / "ddl").mkdir()
    (tmp_path / "d" / "ddl" / "a.sql").write_text(CREATE)
    assert sorted((r.id, r.note) for r in dumps.read_dump(spark, f"{tmp_path}/d/*")["orders"].collect()) == want


@pytest.mark.parametrize("bad", ["COPY orders FROM stdin", "INSERT INTO orders SELECT 1", "(7, 'x')", "INSERT INTO orders VALUES (1, 'open"])
def test_what_cannot_be_read_is_an_error(spark, tmp_path, bad):
    with pytest.raises(Exception, match="can be read|ends inside"):
        rows(spark, tmp_path / "d", CREATE + bad + ";\n")


def by_characters(values):
    """The same list read a character at a time."""
    row, text, quoted, inside, escapes, depth, i = [], "", False, False, False, 0, 0
    while i < len(values):
        ch = values[i]
        if inside:
            if ch == "'" and values[i + 1 : i + 2] == "'":
                text, i = text + "'", i + 1
            elif ch == "'":
                inside = False
            elif ch == "\\" and escapes:
                i += 1
                text += {"n": "\n", "r": "\r"}.get(values[i : i + 1], values[i : i + 1])
            else:
                text += ch
        elif ch == "'":
            inside, quoted, text = True, True, text.strip()
            escapes = text in ("E", "e")
            text = "" if escapes else text
        elif ch == "(" and depth == 0:
            depth, row, text, quoted = 1, [], "", False
        elif depth == 1 and ch in ",)":
            plain = text if quoted else text.strip()
            row.append(None if not quoted and plain.upper() == "NULL" else plain)
            text, quoted = "", False
            if ch == ")":
                depth = 0
                yield row
        elif depth and not (quoted and ch.isspace()):
            depth += (ch == "(") - (ch == ")")
            text += ch
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["(", ")", ",", "'", "''", "E'", "\\", "\\n", " ", "\n", "NULL", "1", "x", "é", "f(", "::int", ";"]), max_size=25).map("".join))
def test_pieces_are_read_like_characters(values):
    assert list(dumps.tuples(values)) == list(by_characters(values))


def test_many_rows_in_one_statement(spark, tmp_path):
    want = [(i, None if i % 5 == 0 else f"it's {i},\n(x)") for i in range(457)]
    dumps.write_dump(spark.createDataFrame(want, "id int, note string").repartition(3), "orders", f"{tmp_path}/d/rows", rows=50)
    text = "".join(p.read_text() for p in (tmp_path / "d" / "rows").glob("*.txt"))
    assert 10 <= text.count("INSERT INTO") <= 12
    (tmp_path / "d" / "ddl").mkdir()
    (tmp_path / "d" / "ddl" / "a.sql").write_text(CREATE)
    assert sorted((r.id, r.note) for r in dumps.read_dump(spark, f"{tmp_path}/d/*")["orders"].collect()) == want


def test_batches_of_parsed_rows_are_bounded():
    """A batch of statements of a hundred rows each gives many batches of rows, and so does one long statement; none is lost."""
    several = [f"INSERT INTO t (a, b) VALUES {', '.join(f'({i}, {j})' for j in range(100))};" for i in range(150)]
    alone = [f"INSERT INTO t VALUES {', '.join(f'({j}, NULL)' for j in range(12_000))};"]
    batches = (pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["value"]) for part in (several, alone))
    got = list(dumps.parse(batches))
    assert max(b.num_rows for b in got) <= dumps.ROWS < 5_000
    rows = [dict(r) for b in got for r in b.column(0).to_pylist()]
    assert rows == [{"a": str(i), "b": str(j)} for i in range(150) for j in range(100)] + [{"0": str(j), "1": None} for j in range(12_000)]


def test_more_statements_than_a_slice(spark, tmp_path):
    n = 3 * dumps.STATEMENTS * 7 + 5
    df = spark.range(n, numPartitions=1).selectExpr("id", "concat('it''s; ', id) AS s")
    dumps.write_dump(df, "t", f"{tmp_path}/rows", rows=7)
    (tmp_path / "ddl.sql").write_text("CREATE TABLE t (id bigint, s text);\n")
    got = dumps.read_dump(spark, f"{tmp_path}/*")["t"].collect()
    assert sorted(map(tuple, got)) == [(i, f"it's; {i}") for i in range(n)]
