"""SQL dumps as tables and tables as SQL dumps, CSV and JSON; packs of tables as folders."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datumloom.plans import star
from datumloom.plans.schema import Column as Column_
from datumloom.plans.schema import Table, ddl_of, order, tables_of
from datumloom.registry import query, table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; in local mode that may be the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


INSERT = re.compile(r'INSERT\s+INTO\s+(?:"?\w+"?\.)?"?(\w+)"?\s*(?:\(([^)]*)\))?\s*VALUES\s*', re.I)


CREATE = re.compile(r"CREATE\s+TABLE", re.I)
#: Space and comments before a statement.
BEFORE = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)*", re.S)
#: Statements that hold no rows, besides CREATE and INSERT.
ROWLESS = re.compile(r"(?:CREATE|ALTER|DROP|SET|USE|BEGIN|START|COMMIT|LOCK|UNLOCK|PRAGMA|ANALYZE|COMMENT|GRANT|REVOKE|SELECT)\b|;?\s*$", re.I)
#: Texts and comments as a whole, or the beginning of one that a cut has left open.
SPANS = re.compile(r"(?<!\w)E'(?:[^'\\]|''|\\.)*(?P<e>'?)|'(?:[^']|'')*(?P<q>'?)|--[^\n]*|/\*.*?(?P<c>\*/|$)", re.I | re.S)
CUT = re.compile(r"(;\r?\n)")


def left_open(part: str) -> bool:
    """Whether a part, begun outside of texts and comments, ends inside one."""
    return any("" in (m["e"], m["q"], m["c"]) for m in SPANS.finditer(part))


#: Statements taken from an Arrow batch at a time, and rows put into one: a batch of ten thousand statements may hold millions of rows.
STATEMENTS, ROWS = 64, 4_096


def slices(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[list[list]]:
    """The first columns of a few rows at a time as Python lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, STATEMENTS):
            yield [c.slice(at, STATEMENTS).to_pylist() for c in batch.columns[:columns]]


#: The pieces of a value list: text outside of quotes, a quoted text, and one with escapes.
PLAIN = re.compile(r"[^'(),]+")
QUOTED = re.compile(r"'([^']*(?:''[^']*)*)'")
ESCAPED = re.compile(r"'([^'\\]*(?:(?:''|\\.)[^'\\]*)*)'", re.S)
ESCAPE = re.compile(r"''|\\(.)", re.S)
SPACE = re.compile(r"\s+")


def _unescaped(m: re.Match) -> str:
    return "'" if m[1] is None else {"n": "\n", "r": "\r"}.get(m[1], m[1])


def tuples(values: str) -> Iterator[list[str | None]]:
    """The value tuples after VALUES: quotes doubled inside quotes, NULL without quotes is null, all else text.

    In E'...' a backslash escapes the next character; n and r are line ends. Read a piece
    at a time. A text that is left open ends the list.
    """
    row: list[str | None] = []
    text, quoted, depth, at = "", False, 0, 0
    while at < len(values):
        if m := PLAIN.match(values, at):
            at = m.end()
            if depth:
                text += SPACE.sub("", m[0]) if quoted else m[0]
            continue
        ch = values[at]
        if ch == "'":
            before = text.strip()
            escapes = before in ("E", "e")
            m = (ESCAPED if escapes else QUOTED).match(values, at)
            if not m:
                return
            quoted, at = True, m.end()
            text = ESCAPE.sub(_unescaped, m[1]) if escapes else before + m[1].replace("''", "'")
            continue
        at += 1
        if ch == "(" and depth == 0:
            depth, row, text, quoted = 1, [], "", False
        elif depth == 1 and ch in ",)":
            plain = text if quoted else text.strip()
            row.append(None if not quoted and plain.upper() == "NULL" else plain)
            text, quoted = "", False
            if ch == ")":
                depth = 0
                yield row
        elif depth:
            depth += (ch == "(") - (ch == ")")
            text += ch


def statements(spark: SparkSession, path: str) -> DataFrame:
    """A dump's statements without the comments before them, cut where a semicolon ends a line.

    A file is read in parallel, by the line end that most of its statements have. Only
    the files where a cut falls into a text or comment go through one task each, in
    their order, and their parts are joined again.
    """
    where = "_metadata.file_path"
    end = F.col("value")
    ends = spark.read.option("lineSep", "\n").text(path).groupBy(F.col(where).alias("file")).agg(F.count_if(end.endswith(";\r")).alias("crlf"), F.count_if(end.endswith(";")).alias("lf"))
    crlf = [r.file for r in ends.where("crlf > lf").collect()]

    def parts(sep: str, files) -> DataFrame:
        order = (F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
        return spark.read.option("lineSep", sep).text(path).where(files).select(F.concat("value", F.lit(sep)).alias("value"), F.col(where).alias("file"), *order)

    known = F.col(where).isin(crlf) if crlf else F.lit(False)
    found = parts(";\n", ~known)
    found = found.unionByName(parts(";\r\n", known)) if crlf else found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (values,) in slices(batches):
            out = []
            for row in values:
                out.extend(CUT.split(row)[:-1:2])
            yield pa.RecordBatch.from_arrays([pa.array([clean(s) for s in out], pa.string())], names=["value"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: set[str] = set()
        for values, of in slices(batches, 2):
            files |= {f for row, f in zip(values, of) if f not in files and any(map(left_open, CUT.split(row)[:-1:2]))}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(files), pa.string())], names=["file"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = "", None
        for values, of in slices(batches, 2):
            out = []
            for row, file in zip(values, of):
                if held and file != last:
                    raise ValueError(f"{last} ends inside a text or comment: {held[:200]!r}")
                last = file
                pieces = CUT.split(row)
                for part, cut in zip(pieces[:-1:2], pieces[1::2]):
                    held += part
                    if left_open(held):
                        held += cut
                    else:
                        out.append(clean(held))
                        held = ""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if held:
            raise ValueError(f"{last} ends inside a text or comment: {held[:200]!r}")

    def clean(statement: str) -> str:
        return statement[BEFORE.match(statement).end() :]

    torn = [r.file for r in found.mapInArrow(opened, "file string").distinct().collect()]
    if not torn:
        return found.select("value").mapInArrow(whole, "value string")
    alone = found.where(F.col("file").isin(torn)).repartition(len(torn), "file").sortWithinPartitions("file", "start", "place").select("value", "file")
    return found.where(~F.col("file").isin(torn)).select("value").mapInArrow(whole, "value string").unionByName(alone.mapInArrow(joined, "value string"))


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of INSERT statements as maps of cells by column, or by place where a statement lists none; a bounded number in each batch."""
    rows: list[list[tuple[str, str | None]]] = []

    def filled() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], names=["row"])
        rows.clear()
        return out

    for (of,) in slices(batches):
        for statement in of:
            m = INSERT.match(statement)
            listed = [c.strip(' "') for c in m[2].split(",")] if m[2] else None
            for values in tuples(statement[m.end() :]):
                rows.append(list(zip(listed or map(str, range(len(values))), values)))
                if len(rows) >= ROWS:
                    yield filled()
    yield filled()


def read_dump(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Each table of a dump with the types of its CREATE TABLE; names like _x_meta are skipped.

    The dump is cut into statements once; these are kept in the shared folder, those of
    each table apart, so that reading a table parses its own rows alone. Only the CREATE
    statements come to the driver. Values that don't fit a column's type are null. A
    statement that may hold rows and can't be read is an error.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (values,) in slices(batches):
            names, kept = [], []
            for statement in values:
                if m := INSERT.match(statement):
                    names.append(m[1])
                    kept.append(statement)
                elif CREATE.match(statement):
                    names.append("")
                    kept.append(statement)
                elif not ROWLESS.match(statement):
                    raise ValueError(f"not a statement of a dump that can be read: {statement[:200]!r}")
            yield pa.RecordBatch.from_arrays([pa.array([f"t{n}" for n in names], pa.string()), pa.array(kept, pa.string())], names=["of", "value"])

    kept = scratch(spark, "statements")
    statements(spark, path).mapInArrow(named, "of string, value string").write.partitionBy("of").parquet(kept)
    found = spark.read.schema("value string, of string").parquet(kept)
    ddl = [r.value for r in found.where("of = 't'").select("value").collect()]

    out = {}
    for t in tables_of(";\n".join(ddl) + ";"):
        if re.fullmatch(r"_.*_meta", t.name):
            continue
        rows = found.where(F.col("of") == f"t{t.name}").select("value").mapInArrow(parse, "row map<string,string>")
        # A statement without a column list numbers its values.
        cells = [F.coalesce(F.col("row")[c.name], F.col("row")[str(i)]) for i, c in enumerate(t.columns)]
        out[t.name] = rows.select(*(v.try_cast(c.type).alias(c.name) for v, c in zip(cells, t.columns)))
    return out


def literal(name: str, kind: str) -> Column:
    """A cell as a SQL literal: NULL, TRUE or FALSE, a number as it is, else text with quotes doubled, line ends escaped in E'...'."""
    c = F.col(name)
    if kind in ("int", "bigint", "smallint", "double", "float") or kind.startswith("decimal"):
        text = c.cast("string")
    elif kind == "boolean":
        text = F.when(c, "TRUE").otherwise("FALSE")
    else:
        doubled = F.replace(c.cast("string"), F.lit("'"), F.lit("''"))
        escaped = doubled
        for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            escaped = F.replace(escaped, F.lit(plain), F.lit(code))
        lined = doubled.contains("\n") | doubled.contains("\r")
        text = F.when(lined, F.concat(F.lit("E'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))
    return F.when(c.isNull(), "NULL").otherwise(text)


#: Rows of one INSERT statement, at most.
INSERT_ROWS = 100


def write_dump(df: DataFrame, name: str, path: str, rows: int = INSERT_ROWS) -> None:
    """INSERT statements of up to ``rows`` rows each, ended by a semicolon and a line end; a folder of part files."""
    row = F.concat(F.lit("("), F.concat_ws(", ", *(literal(c, k) for c, k in df.dtypes)), F.lit(")"))
    head = f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES "

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            out = [head + ",\n".join(values[i : i + rows]) for i in range(0, len(values), rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    df.select(row.alias("value")).mapInArrow(joined, "value string").write.option("lineSep", ";\n").text(path)


def write_dumps(tables: dict[str, DataFrame], schemas: list[Table], path: str) -> list[str]:
    """A dump of several tables: their CREATE TABLE statements, and a folder of INSERT statements for each, parents first by name.

    Returns the folders in the order in which a database should read them.
    """
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(ddl_of(schemas),)], "value string").coalesce(1).write.text(f"{path}/000_schema")
    names = [n for n in order(schemas)[0] if n in tables]
    out = [f"{path}/{i:03d}_{n}" for i, n in enumerate(names, 1)]
    for n, folder in zip(names, out):
        write_dump(tables[n], n, folder)
    return [f"{path}/000_schema", *out]


def save_pack(tables: dict[str, DataFrame], path: str, **about) -> None:
    """Tables as Parquet beside a manifest of their schemas; the manifest comes last, so a half-written pack has none."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/tables/{name}")
    manifest = json.dumps(about | {"tables": {n: json.loads(d.schema.json()) for n, d in tables.items()}})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load_pack(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest").first()[0])
    return {n: spark.read.parquet(f"{path}/tables/{n}") for n in manifest["tables"]}, manifest


_TEXTS = "SELECT c_custkey, c_name || ' o''clock' AS c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"


def _quoted(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.withColumn("c_name", F.concat("c_name", F.lit(" o'clock"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))


@query("sql_dump_round_trip", _TEXTS)
def sql_dump_round_trip(spark, sf_dir):
    """Customers written as INSERT statements and read again with a CREATE TABLE."""
    path = scratch(spark, "dump")
    write_dump(_quoted(spark, sf_dir), "customer", f"{path}/rows")
    spark.createDataFrame([("CREATE TABLE customer (c_custkey bigint PRIMARY KEY, c_name varchar(40) NOT NULL, c_nationkey int, c_acctbal double precision, c_mktsegment text)",)], "value string").coalesce(1).write.option("lineSep", ";\n").text(f"{path}/ddl")
    return read_dump(spark, f"{path}/*")["customer"]


@query("csv_round_trip", _TEXTS)
def csv_round_trip(spark, sf_dir):
    df = _quoted(spark, sf_dir)
    path = scratch(spark, "csv")
    df.write.csv(path, header=True, quoteAll=False, escape='"')
    return spark.read.csv(path, header=True, schema=df.schema, escape='"')


@query("json_round_trip", _TEXTS)
def json_round_trip(spark, sf_dir):
    df = _quoted(spark, sf_dir)
    path = scratch(spark, "json")
    df.write.json(path)
    return spark.read.schema(df.schema).json(path)


@query("pack_round_trip", _TEXTS)
def pack_round_trip(spark, sf_dir):
    path = scratch(spark, "pack")
    save_pack({"customer": _quoted(spark, sf_dir)}, path, seed=42)
    return load_pack(spark, path)[0]["customer"]


_LINKED = " ".join(f"WHEN table_name = '{t}' AND column_name = '{c}' THEN 'references {p}.{k}'" for t, c, p, k in star.FOREIGN_KEYS)
_PRIMARY = " ".join(f"WHEN table_name = '{t}' AND column_name = '{c}' THEN 'primary'" for t, c in star.PRIMARY_KEYS.items())


@query(
    "catalog_scan",
    f"""SELECT table_name AS "table", column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(data_type) END AS type, CASE {_PRIMARY} {_LINKED} END AS key
 FROM information_schema.columns WHERE table_name IN ('customer', 'lineitem', 'region')""",
)
def catalog_scan(spark, sf_dir):
    """Columns, types, and the keys that the schema declares, of tables; metadata alone."""
    links = {(t, c): f"references {p}.{k}" for t, c, p, k in star.FOREIGN_KEYS}
    rows = [(t, c, k.removesuffix("_ntz"), "primary" if star.PRIMARY_KEYS.get(t) == c else links.get((t, c))) for t in ("customer", "lineitem", "region") for c, k in table(spark, sf_dir, t).dtypes]
    return spark.createDataFrame(rows, "table string, column string, type string, key string")


@query("row_counts", "SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def row_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.lit("customer").alias("table"), F.count("*").alias("n")).unionByName(table(spark, sf_dir, "orders").agg(F.lit("orders").alias("table"), F.count("*").alias("n")))


@query(
    "linked_dump_round_trip",
    """SELECT o_orderkey, c_name, n_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def linked_dump_round_trip(spark, sf_dir):
    """Three tables written as one dump with their schema, read again and joined."""
    names = ("nation", "customer", "orders")
    tables = {t: table(spark, sf_dir, t) for t in names}
    parents = {(t, c): (p, k) for t, c, p, k in star.FOREIGN_KEYS if t in names and p in names}
    schemas = [Table(t, [Column_(f.name, f.dataType, f.nullable, star.PRIMARY_KEYS[t] == f.name, parents.get((t, f.name))) for f in df.schema]) for t, df in tables.items()]
    path = scratch(spark, "dumps")
    write_dumps(tables, schemas, path)
    read = read_dump(spark, f"{path}/*")
    rows = read["orders"].join(read["customer"], F.col("o_custkey") == F.col("c_custkey")).join(read["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "c_name", "n_name", "o_orderpriority")
