"""Generating tables: distributions, references by function, cascades, timelines, correlated columns, identifiers.

A table is ``spark.range`` with columns that depend on (seed, table, column, row), so it
needs no shuffle and no driver data. A reference is the key of the parent's row number
floor(u * parents), so children never join their parents to find one, and what a child
copies from its parent is computed from that row number again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datumloom.functions import checks, numbers
from datumloom.functions.numbers import places, places_sql, uniform, uniform_sql
from datumloom.operators.split import ranked
from datumloom.plans.schema import growth
from datumloom.registry import query

ROWS = 2000
SEED = 77


def u(table: str, column: str, draw: int = 0, row: str = "id"):
    return uniform(SEED, table, column, F.col(row), draw)


def usql(table: str, column: str, draw: int = 0, row: str = "id") -> str:
    return uniform_sql(SEED, table, column, row, draw)


R = f"range({ROWS}) r(id)"


def rows(spark, n: int = ROWS) -> DataFrame:
    return spark.range(n)


@query("uniform_u", f"SELECT id, {usql('t', 'c')} AS u FROM {R}")
def uniform_u(spark, sf_dir):
    return rows(spark).select("id", u("t", "c").alias("u"))


_DISTRIBUTIONS = {
    "normal": (lambda: numbers.bounded(numbers.normal(u("d", "n", 0), u("d", "n", 1), 50, 10), 20, 80), f"greatest(20, least(80, {numbers.normal_sql(usql('d', 'n', 0), usql('d', 'n', 1), 50, 10)}))"),
    "lognormal": (lambda: numbers.lognormal(u("d", "l", 0), u("d", "l", 1), 1.5, 0.5), f"exp({numbers.normal_sql(usql('d', 'l', 0), usql('d', 'l', 1), 1.5, 0.5)})"),
    "exponential": (lambda: numbers.exponential(u("d", "e"), 0.5), f"-ln(greatest({usql('d', 'e')}, 1e-10)) / 0.5::DOUBLE"),
    "weibull": (lambda: numbers.weibull(u("d", "w"), 1.5, 10.0), f"10::DOUBLE * pow(-ln(1 - {usql('d', 'w')}), {1 / 1.5!r}::DOUBLE)"),
    "gamma": (lambda: numbers.gamma([u("d", "g", k) for k in range(3)], 2.0), "2::DOUBLE * (" + " + ".join(f"-ln(greatest({usql('d', 'g', k)}, 1e-10))" for k in range(3)) + ")"),
    "uniform": (lambda: 5 + u("d", "u") * 10, f"5 + {usql('d', 'u')} * 10"),
    "long_tail": (lambda: numbers.long_tail(u("d", "t"), 1, 1000).cast("double"), f"floor(1 + pow({usql('d', 't')}, 2.0::DOUBLE) * 999)"),
    "zipf": (lambda: numbers.zipf(u("d", "z"), 20, 1.1).cast("double"), "(len(list_filter([" + ", ".join(f"{c!r}::DOUBLE" for c in numbers.zipf_cumulative(20, 1.1)[:-1]) + f"], lambda c: c <= {usql('d', 'z')})) + 1)::DOUBLE"),
}


def _register(name: str) -> None:
    make, sql = _DISTRIBUTIONS[name]

    @query(f"dist_{name}", f"SELECT id, {places_sql(sql, 6)} AS x FROM {R}")
    def run(spark, sf_dir):
        return rows(spark).select("id", places(make(), 6).alias("x"))


for _name in _DISTRIBUTIONS:
    _register(_name)

FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dov", "Eva", "Finn", "Gus", "Hana")
WEIGHTS = {"active": 6, "paused": 3, "closed": 1}
CITIES = {"DE": ["Berlin", "Hamburg"], "FR": ["Paris", "Lyon", "Lille"], "IT": ["Rome"]}

_HEX = lambda draw: f"substr(md5('{SEED}|s|uuid|' || id || '|{draw}'), 1, 32)"

#: strategy -> (column, the same in SQL)
STRATEGIES = {
    "uuid": (
        lambda: F.regexp_replace(F.md5(F.concat(F.lit(f"{SEED}|s|uuid|"), F.col("id").cast("string"), F.lit("|0"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        f"regexp_replace({_HEX(0)}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')",
    ),
    "name": (lambda: numbers.choice(u("s", "name"), list(FIRST_NAMES)), f"{list(FIRST_NAMES)!r}[floor({usql('s', 'name')} * 8)::INT + 1]"),
    "enum": (lambda: numbers.weighted(u("s", "enum"), WEIGHTS), numbers.weighted_sql(usql("s", "enum"), WEIGHTS)),
    "integer": (lambda: numbers.integer(u("s", "integer"), 10, 99), f"(10 + floor({usql('s', 'integer')} * 90))::INT"),
    "money": (lambda: F.floor(u("s", "money") * 100000) / 100, f"floor({usql('s', 'money')} * 100000) / 100"),
    "boolean": (lambda: u("s", "boolean") < 0.7, f"{usql('s', 'boolean')} < 0.7"),
    "timestamp": (
        lambda: F.timestamp_seconds(1704067200 + F.floor(u("s", "timestamp") * 31536000)).cast("timestamp_ntz"),
        f"make_timestamp((1704067200 + floor({usql('s', 'timestamp')} * 31536000)::BIGINT) * 1000000)",
    ),
    "email": (lambda: F.concat(F.lower(numbers.choice(u("s", "name"), list(FIRST_NAMES))), F.col("id").cast("string"), F.lit("@example.com")), f"lower({list(FIRST_NAMES)!r}[floor({usql('s', 'name')} * 8)::INT + 1]) || id || '@example.com'"),
    "phone": (lambda: F.concat(F.lit("555-"), F.lpad(F.floor(u("s", "phone") * 10000000).cast("string"), 7, "0")), f"'555-' || lpad(floor({usql('s', 'phone')} * 10000000)::BIGINT::VARCHAR, 7, '0')"),
    "sku": (lambda: F.concat(F.lit("SKU-"), F.upper(F.substring(F.md5(F.col("id").cast("string")), 1, 6))), "'SKU-' || upper(substr(md5(id::VARCHAR), 1, 6))"),
    "sequential": (lambda: F.format_string("INV-%06d", F.col("id")), "printf('INV-%06d', id)"),
    "digit_string": (lambda: F.lpad(F.floor(u("s", "digits") * 1e9).cast("long").cast("string"), 9, "0"), f"lpad(floor({usql('s', 'digits')} * 1e9)::BIGINT::VARCHAR, 9, '0')"),
    "text": (lambda: F.concat_ws(" ", *(numbers.choice(u("s", "text", k), list(FIRST_NAMES)) for k in range(4))), " || ' ' || ".join(f"{list(FIRST_NAMES)!r}[floor({usql('s', 'text', k)} * 8)::INT + 1]" for k in range(4))),
    "past_date": (lambda: F.date_sub(F.lit("2024-01-01").cast("date"), (1 + F.floor(u("s", "past") * 365)).cast("int")), f"DATE '2024-01-01' - (1 + floor({usql('s', 'past')} * 365))::INT"),
    "future_date": (lambda: F.date_add(F.lit("2024-01-01").cast("date"), (1 + F.floor(u("s", "future") * 365)).cast("int")), f"DATE '2024-01-01' + (1 + floor({usql('s', 'future')} * 365))::INT"),
}


def _register_strategy(name: str) -> None:
    make, sql = STRATEGIES[name]

    @query(f"strategy_{name}", f"SELECT id, {sql} AS value FROM {R}")
    def run(spark, sf_dir):
        return rows(spark).select("id", make().alias("value"))


for _name in STRATEGIES:
    _register_strategy(_name)

PARENTS = 300


def parent_of(table: str, n: int):
    return F.floor(u(table, "parent") * n)


@query("fk_by_function", f"SELECT id, floor({usql('child', 'parent')} * {PARENTS})::BIGINT AS parent_id FROM {R}")
def fk_by_function(spark, sf_dir):
    return rows(spark).select("id", parent_of("child", PARENTS).alias("parent_id"))


@query("self_fk", f"SELECT id, CASE WHEN id >= {int(ROWS * 0.3)} THEN floor({usql('tree', 'parent')} * id)::BIGINT END AS parent_id FROM {R}")
def self_fk(spark, sf_dir):
    """The first three tenths are roots; the others point to an earlier row."""
    return rows(spark).select("id", F.when(F.col("id") >= int(ROWS * 0.3), F.floor(u("tree", "parent") * F.col("id"))).alias("parent_id"))


_COUNTRY = "['DE', 'FR', 'IT'][floor({u} * 3)::INT + 1]"


@query("cascade", f"SELECT id, parent_id, {_COUNTRY.format(u=usql('parent', 'country', 0, 'parent_id'))} AS country FROM (SELECT id, floor({usql('child', 'parent')} * {PARENTS})::BIGINT AS parent_id FROM {R}) c")
def cascade(spark, sf_dir):
    """A child's copy of its parent's country, computed from the parent's row number: no join."""
    child = rows(spark).select("id", parent_of("child", PARENTS).alias("parent_id"))
    return child.withColumn("country", numbers.choice(u("parent", "country", 0, "parent_id"), ["DE", "FR", "IT"]))


@query("dependent_enum", f"SELECT id, country, CASE country {' '.join(f'WHEN {c!r} THEN {v!r}[floor({usql("city", "pick")} * {len(v)})::INT + 1]' for c, v in CITIES.items())} ELSE 'unknown' END AS city FROM (SELECT id, ['DE', 'FR', 'IT', 'XX'][floor({usql('city', 'country')} * 4)::INT + 1] AS country FROM {R}) t")
def dependent_enum(spark, sf_dir):
    """A value drawn from the pool of its sibling column."""
    df = rows(spark).withColumn("country", numbers.choice(u("city", "country"), ["DE", "FR", "IT", "XX"]))
    pick = None
    for c, pool in CITIES.items():
        value = numbers.choice(u("city", "pick"), pool)
        pick = F.when(F.col("country") == c, value) if pick is None else pick.when(F.col("country") == c, value)
    return df.withColumn("city", pick.otherwise("unknown"))


@query("date_after", f"SELECT id, started, started + (5 + floor({usql('dates', 'gap')} * 25))::INT AS ended FROM (SELECT id, DATE '2024-01-01' + floor({usql('dates', 'start')} * 365)::INT AS started FROM {R}) t")
def date_after(spark, sf_dir):
    df = rows(spark).withColumn("started", F.date_add(F.lit("2024-01-01").cast("date"), F.floor(u("dates", "start") * 365).cast("int")))
    return df.withColumn("ended", F.date_add("started", (5 + F.floor(u("dates", "gap") * 25)).cast("int")))


def timeline(spark, model: str, n: int, total: int) -> DataFrame:
    """Rows over ``n`` months by a growth model, each at a time within its month.

    Only the slots' counts are a table of the driver; rows come from sequences on the executors.
    """
    counts = growth(model, n, total)
    slots = spark.createDataFrame(list(enumerate(counts)), "slot int, n int").withColumn("start", F.add_months(F.lit("2024-01-01").cast("date"), F.col("slot")))
    each = slots.where("n > 0").select("slot", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    each = each.withColumn("key", F.concat_ws("-", "slot", "k"))
    days = F.dayofmonth(F.last_day("start"))
    return each.select("slot", "k", F.date_add("start", F.floor(uniform(SEED, "timeline", model, F.col("key")) * days).cast("int")).alias("day"))


def _register_growth(model: str) -> None:
    counts = growth(model, 12, 1200)
    values = ", ".join(f"({i}, {c})" for i, c in enumerate(counts))
    v = uniform_sql(SEED, "timeline", model, "slot || '-' || k")

    @query(
        f"growth_{model}",
        f"SELECT slot, k, start + floor({v} * day(last_day(start)))::INT AS day FROM (SELECT slot::INT AS slot, unnest(range(n))::INT AS k, (DATE '2024-01-01' + INTERVAL 1 MONTH * slot::INT)::DATE AS start FROM (VALUES {values}) s(slot, n)) t",
    )
    def run(spark, sf_dir):
        return timeline(spark, model, 12, 1200)


for _model in ("linear", "exponential", "s_curve", "flat"):
    _register_growth(_model)

RHO = 0.6


@query(
    "rank_correlation",
    f"""WITH t AS (SELECT id, {places_sql(numbers.normal_sql(usql('rc', 'x', 0), usql('rc', 'x', 1), 0, 1), 6)} AS x, {places_sql(usql('rc', 'y'), 6)} AS y FROM {R}),
 a AS (SELECT *, row_number() OVER (ORDER BY x, id) AS rx, row_number() OVER (ORDER BY y, id) AS ry FROM t)
 SELECT a.id, a.x, {places_sql(f'{RHO}::DOUBLE * b.y + {1 - RHO}::DOUBLE * a.y', 6)} AS y FROM a JOIN a b ON b.ry = a.rx""",
)
def rank_correlation(spark, sf_dir):
    """y drawn towards the y whose rank equals the rank of x."""
    df = rows(spark).select("id", places(numbers.normal(u("rc", "x", 0), u("rc", "x", 1)), 6).alias("x"), places(u("rc", "y"), 6).alias("y"))
    # Ranks by ranges of the values, so no task sorts a whole column.
    a = ranked(df, F.struct("x", "id"), F.floor(F.col("x") * 8))
    b = ranked(df.select("id", "y"), F.struct("y", "id"), F.floor(F.col("y") * 64)).select(F.col("y").alias("other"), "_rank")
    return a.join(b, "_rank").select("id", "x", places(RHO * F.col("other") + (1 - RHO) * F.col("y"), 6).alias("y"))


@query("correlated_noise", f"SELECT id, x, {places_sql(f'greatest(0, least(1, {RHO}::DOUBLE * x + {1 - RHO}::DOUBLE * ({usql("cn", "noise")} - 0.5) * 2))', 6)} AS y FROM (SELECT id, {usql('cn', 'x')} AS x FROM {R}) t")
def correlated_noise(spark, sf_dir):
    df = rows(spark).withColumn("x", u("cn", "x"))
    return df.select("id", "x", places(numbers.bounded(RHO * F.col("x") + (1 - RHO) * (u("cn", "noise") - 0.5) * 2, 0.0, 1.0), 6).alias("y"))


@query("row_distribution", "SELECT * FROM (VALUES ('customer', 300), ('lineitem', 300), ('orders', 300), ('region', 600)) v(\"table\", n)")
def row_distribution(spark, sf_dir):
    from datumloom.plans.schema import row_counts, tables_of

    ddl = "CREATE TABLE region (id int PRIMARY KEY); CREATE TABLE customer (id int PRIMARY KEY, r int REFERENCES region(id)); CREATE TABLE orders (id int PRIMARY KEY, c int REFERENCES customer(id)); CREATE TABLE lineitem (id int PRIMARY KEY, o int REFERENCES orders(id));"
    return spark.createDataFrame(sorted(row_counts(tables_of(ddl), 1500).items()), "table string, n int")


_ACCOUNT = f"lpad(floor({usql('iban', 'a')} * 1e9)::BIGINT::VARCHAR, 9, '0') || lpad(floor({usql('iban', 'b')} * 1e9)::BIGINT::VARCHAR, 9, '0')"


@query("iban_check", f"SELECT id, 'DE' || lpad((98 - (account || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || account AS iban, true AS valid FROM (SELECT id, {_ACCOUNT} AS account FROM {R}) t")
def iban_check(spark, sf_dir):
    account = F.concat(*(F.lpad(F.floor(u("iban", k) * 1e9).cast("long").cast("string"), 9, "0") for k in "ab"))
    made = rows(spark).select("id", F.concat(F.lit("DE"), checks.iban_check_digits(F.lit("DE"), account), account).alias("iban"))
    return made.withColumn("valid", checks.iban_valid(F.col("iban")))


_EIGHT = f"lpad(floor({usql('aba', 'n')} * 1e8)::BIGINT::VARCHAR, 8, '0')"


@query("aba_check", "SELECT id, e || ((10 - (" + " + ".join(f"substr(e, {i + 1}, 1)::INT * {w}" for i, w in enumerate([3, 7, 1, 3, 7, 1, 3, 7])) + f") % 10) % 10)::VARCHAR AS routing, true AS valid FROM (SELECT id, {_EIGHT} AS e FROM {R}) t")
def aba_check(spark, sf_dir):
    eight = F.lpad(F.floor(u("aba", "n") * 1e8).cast("long").cast("string"), 8, "0")
    return rows(spark).select("id", F.concat(eight, checks.aba_check_digit(eight)).alias("routing")).withColumn("valid", checks.aba_valid(F.col("routing")))


_SIREN = f"lpad(floor({usql('vat', 'n')} * 1e9)::BIGINT::VARCHAR, 9, '0')"


@query("vat_check", f"SELECT id, 'FR' || lpad(((12 + 3 * (s::BIGINT % 97)) % 97)::VARCHAR, 2, '0') || s AS vat FROM (SELECT id, {_SIREN} AS s FROM {R}) t")
def vat_check(spark, sf_dir):
    siren = F.lpad(F.floor(u("vat", "n") * 1e9).cast("long").cast("string"), 9, "0")
    return rows(spark).select("id", F.concat(F.lit("FR"), checks.vat_key_fr(siren), siren).alias("vat"))


def _vn(i: int, n: int, c: str) -> str:
    return f"lpad(floor({usql('vat', c, i)} * 1e{n})::BIGINT::VARCHAR, {n}, '0')"


_FR = f"(floor({usql('vat', 'FR', 0)} * 900000000) + 100000000)::BIGINT"
_IT = f"{_vn(0, 5, 'IT')} || {_vn(1, 5, 'IT')}"
_VATS = {
    "DE": f"'DE' || {_vn(0, 5, 'DE')} || {_vn(1, 4, 'DE')}",
    "FR": f"'FR' || lpad(((12 + 3 * ({_FR} % 97)) % 97)::VARCHAR, 2, '0') || {_FR}::VARCHAR",
    "IT": "(SELECT 'IT' || b || ((10 - list_sum(list_transform(range(10), lambda i: CASE WHEN i % 2 = 0 THEN b[i + 1]::INT ELSE (b[i + 1]::INT * 2) // 10 + (b[i + 1]::INT * 2) % 10 END)) % 10) % 10)::INT::VARCHAR FROM (SELECT " + _IT + " AS b) x)",
    "ES": f"'ES' || substr('ABCDEFGHJKLMNPQRSUVW', floor({usql('vat', 'ES', 0)} * 20)::INT + 1, 1) || {_vn(1, 5, 'ES')} || {_vn(2, 3, 'ES')}",
    "NL": f"'NL' || {_vn(0, 5, 'NL')} || {_vn(1, 4, 'NL')} || 'B' || lpad((floor({usql('vat', 'NL', 3)} * 99) + 1)::INT::VARCHAR, 2, '0')",
    "AT": f"'ATU' || {_vn(1, 5, 'AT')} || {_vn(2, 3, 'AT')}",
    "BE": f"'BE' || floor({usql('vat', 'BE', 0)} * 2)::INT::VARCHAR || {_vn(1, 5, 'BE')} || {_vn(2, 4, 'BE')}",
    "IE": f"'IE' || {_vn(0, 5, 'IE')} || {_vn(1, 2, 'IE')} || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', floor({usql('vat', 'IE', 2)} * 26)::INT + 1, 1)",
    "PL": f"'PL' || {_vn(0, 5, 'PL')} || {_vn(1, 5, 'PL')}",
    "SE": f"'SE' || {_vn(0, 5, 'SE')} || {_vn(1, 5, 'SE')} || '01'",
}


@query("vat_numbers", " UNION ALL ".join(f"SELECT id, '{c}' AS country, {sql} AS vat FROM {R}" for c, sql in _VATS.items()))
def vat_numbers(spark, sf_dir):
    """A VAT number of each of ten countries in every row, with check digits where the country has them."""
    made = [F.struct(F.lit(c).alias("country"), checks.vat_number(c, lambda i, c=c: u("vat", c, i)).alias("vat")) for c in _VATS]
    return rows(spark).select("id", F.explode(F.array(*made)).alias("v")).select("id", "v.*")


_CHANCES = numbers.poisson_cumulative(3.5)


@query("dist_poisson", f"SELECT id, len(list_filter([{', '.join(f'{c!r}::DOUBLE' for c in _CHANCES)}], lambda c: c <= {usql('d', 'p')}))::INT AS x FROM {R}")
def dist_poisson(spark, sf_dir):
    return rows(spark).select("id", numbers.poisson(u("d", "p"), 3.5).alias("x"))


@query("business_days", "SELECT day, dayofweek(day) BETWEEN 1 AND 5 AND strftime(day, '%m-%d') NOT IN ('01-01', '05-01', '10-03', '12-25', '12-26') AS is_business FROM (SELECT (DATE '2024-01-01' + i::INT)::DATE AS day FROM range(366) r(i)) t")
def business_days(spark, sf_dir):
    return spark.range(366).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day")).withColumn("is_business", checks.business_day(F.col("day")))


@query("lifecycle_nulls", f"SELECT id, status, CASE WHEN status = 'closed' THEN DATE '2024-06-01' + floor({usql('ln', 'd')} * 30)::INT END AS closed_on FROM (SELECT id, {numbers.weighted_sql(usql('ln', 's'), WEIGHTS)} AS status FROM {R}) t")
def lifecycle_nulls(spark, sf_dir):
    df = rows(spark).withColumn("status", numbers.weighted(u("ln", "s"), WEIGHTS))
    return df.withColumn("closed_on", F.when(F.col("status") == "closed", F.date_add(F.lit("2024-06-01").cast("date"), F.floor(u("ln", "d") * 30).cast("int"))))
