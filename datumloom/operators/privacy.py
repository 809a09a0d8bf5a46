"""Finding and protecting personal data: name rules, value scanners, masking, tokens, an audit chain."""

from __future__ import annotations

import functools
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import NumericType

from datumloom.functions.numbers import places, places_sql, uniform, uniform_sql
from datumloom.plans import star
from datumloom.registry import TABLES, query, table

# Column names that tell of personal data, by category, in the order in which they are tried.
NAMES = {
    "email": ("email", "email_address", "e_mail", "user_email", "contact_email"),
    "name": ("first_name", "fname", "given_name", "last_name", "lname", "surname", "family_name", "full_name", "display_name", "middle_name"),
    "phone": ("phone", "phone_number", "mobile", "mobile_number", "cell", "telephone", "fax", "home_phone", "work_phone"),
    "address": ("address", "street", "street_address", "city", "state", "zip", "zip_code", "postal_code", "mailing_address", "billing_address", "shipping_address"),
    "ssn": ("ssn", "social_security", "tax_id", "national_id", "sin", "nin"),
    "date_of_birth": ("date_of_birth", "dob", "birth_date", "birthday", "birthdate"),
    "ip_address": ("ip", "ip_address", "ipv4", "ipv6", "remote_ip", "client_ip", "source_ip"),
    "username": ("username", "user_name", "login", "screen_name", "handle", "nickname"),
    "url": ("url", "website", "homepage", "profile_url", "avatar_url", "photo_url", "image_url"),
    "medical": ("diagnosis", "condition", "medication", "prescription", "treatment", "medical_record", "mrn", "insurance_id", "policy_number"),
    "financial": ("account_number", "routing_number", "card_number", "credit_card", "iban", "swift", "bank_account"),
    "quasi": ("age", "gender", "ethnicity", "race", "marital_status", "income", "salary", "occupation", "employer"),
}
CONTAINED = {"email": ("email",), "phone": ("phone", "mobile"), "address": ("address", "street"), "ip_address": ("_ip",), "url": ("_url",), "medical": ("diagnos", "medic", "prescri"), "financial": ("card_", "account_num")}
# Tables of persons, where "name" and names with "_name" in them are personal; words of free-text columns.
PERSON_TABLES = ("users", "user", "people", "person", "contacts", "contact", "members", "member", "employees", "employee", "customers", "customer", "patients", "patient", "profiles", "profile", "staff")
FREE_TEXT = ("note", "comment", "description", "bio", "about", "message")
# How a column of each category is masked.
STRATEGIES = {
    "email": "replace_email",
    "name": "replace_name",
    "phone": "replace_phone",
    "address": "replace_address",
    "ssn": "replace_ssn",
    "date_of_birth": "shift_date",
    "ip_address": "replace_ip",
    "username": "replace_username",
    "url": "replace_url",
    "medical": "redact",
    "financial": "replace_ssn",
    "quasi": "generalize_numeric",
    "free_text": "replace_text",
    "safe": "preserve",
}

# Patterns of values, with the share of a column's values from which a category counts, and what to do then.
VALUES = {
    "email": ((r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",), 0.3, "tokenize"),
    "ssn": ((r"\b\d{3}-\d{2}-\d{4}\b",), 0.1, "block"),
    "phone": ((r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\+1\d{10}\b", r"\(\d{3}\)\s?\d{3}[-.]?\d{4}"), 0.2, "tokenize"),
    "ip_address": ((r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",), 0.2, "mask"),
    "name": ((r"\b(Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), 0.3, "tokenize"),
    "address": ((r"(?i)\b\d{1,5}\s+[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s+(St|Ave|Blvd|Dr|Ln|Rd|Way|Ct|Pl|Ter|Cir|Pike|Highway|Hwy)\b",), 0.2, "tokenize"),
    "financial": ((r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})?\b"), 0.1, "block"),
    "bank_routing": ((r"\b0[0-9]\d{7}\b", r"\b1[0-2]\d{7}\b", r"\b[2-3][0-9]\d{7}\b"), 0.1, "mask"),
    "date_of_birth": ((r"\b(0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])[/-](19|20)\d{2}\b", r"\b(19|20)\d{2}[/-](0[1-9]|1[0-2])[/-](0[1-9]|[12]\d|3[01])\b"), 0.15, "mask"),
    "drivers_license": ((r"\b[A-Z]\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{3}\b",), 0.1, "block"),
    "passport": ((r"\b[A-Z]\d{8}\b",), 0.1, "block"),
    "url": ((r"https?://[^\s\"'<>]+",), 0.3, "tokenize"),
    "medical": ((r"(?i)\bMRN[-:\s]?\d{6,10}\b", r"(?i)\bNPI[-:\s]?\d{10}\b"), 0.1, "tokenize"),
    "student_id": ((r"(?i)\b(SID|STU|STUDENT)[-:\s]?\d{5,10}\b",), 0.15, "tokenize"),
    "case_number": ((r"(?i)\b\d{2,4}[-]?[A-Z]{2,4}[-]?\d{3,8}\b",), 0.1, "tokenize"),
    "vin": ((r"\b[A-HJ-NPR-Z0-9]{17}\b",), 0.1, "block"),
}
# Fixed value: the characters that \s stands for in the reference; both engines here know ASCII's alone.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def with_white(pattern: str) -> str:
    r"""A pattern whose \s is written out, inside and outside of classes."""
    inside, out, i = False, "", 0
    while i < len(pattern):
        if pattern[i] == "\\":
            step = pattern[i : i + 2]
            out += step if step != r"\s" else WHITE if inside else f"[{WHITE}]"
            i += 2
            continue
        inside = pattern[i] == "[" or (inside and pattern[i] != "]")
        out += pattern[i]
        i += 1
    return out


def with_folds(pattern: str) -> str:
    """A pattern without case whose letters find the long s and the Kelvin sign too, as in the SQL; Java folds ASCII alone."""
    folds = {"a-z": r"\x{17F}\x{212A}", "s": r"\x{17F}", "k": r"\x{212A}"}

    def more(m: re.Match) -> str:
        found = m[0]
        return found if found[0] == "\\" else found + folds["a-z"] if len(found) > 1 else f"[{found}{folds[found.lower()]}]"

    return re.sub(r"\\.|A-Z|a-z|[SsKk]", more, pattern)


def for_java(pattern: str) -> str:
    r"""A pattern for Spark.

    \b is a boundary of ASCII words in the reference. All are at an end of a pattern,
    beside a word character, so a look at the other side is enough, but for a letter with
    folds at the start. Java repeats a group by recursion, which a few thousand words
    overflow; a possessive group whose words aren't the last one finds the same texts in
    a loop.
    """
    flag, rest = (pattern[:4], with_folds(pattern[4:])) if pattern.startswith("(?i)") else ("", pattern)
    word = "[0-9A-Za-z_]"
    if flag and re.match(r"\\b\(?\[", rest):
        rest = f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))" + rest[2:]
    rest = re.sub(r"^\\b", f"(?<!{word})", rest)
    rest = re.sub(r"\\b$", f"(?!{word})", rest)
    if m := re.match(r"(.*?)\((\\s\+)(\[A-Z[^]]*\]\[a-z[^]]*\]\+)\)\*(.*)", rest):
        last = m[4].removeprefix(r"\s+")
        rest = f"{m[1]}(?:{m[2]}(?!{last}){m[3]})*+{m[4]}"
    return flag + with_white(rest)


def for_sql(patterns: tuple[str, ...]) -> str:
    """Alternatives as one pattern for DuckDB, in quotes."""
    joined = "|".join(f"(?:{with_white(p)})" for p in patterns)
    return "'" + joined.replace("'", "''") + "'"


def has(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of a category's patterns occurs.

    A text without a character that all of them need is done with after a plain search for it.
    A class such as [A-Z0-9] needs no digit; only \\d asks for one.
    """
    found = functools.reduce(Column.__or__, (text.rlike(for_java(p)) for p in patterns))
    needed = "@" if all("@" in p for p in patterns) else "://" if all("://" in p for p in patterns) else None
    if needed:
        return F.contains(text, F.lit(needed)) & found
    return text.rlike("[0-9]") & found if all(r"\d" in p for p in patterns) else found


#: The eighteen identifiers, of which each found category covers one.
HIPAA_18 = ("names", "geographic", "dates", "phone", "fax", "email", "ssn", "mrn", "health_plan", "account", "certificate", "vehicle", "device", "url", "ip", "biometric", "photo", "other")
COVERS = {"name": "names", "address": "geographic", "date_of_birth": "dates", "phone": "phone", "email": "email", "ssn": "ssn", "medical": "mrn", "financial": "account", "vin": "vehicle", "url": "url", "ip_address": "ip"}


def category(column: str, keys: frozenset[str] = frozenset(), mode: str = "strict", table_name: str = "", long_text: bool = False) -> str:
    """The category of a column by its name and table.

    Keys and references are safe. Medical names count under hipaa and strict only, words
    of free text under gdpr and strict only, and there for long text columns.
    """
    name, person = column.lower(), table_name.lower() in PERSON_TABLES
    if column in keys:
        return "safe"
    for kind, names in NAMES.items():
        if kind == "medical" and mode == "gdpr":
            continue
        if name in names or any(part in name for part in CONTAINED.get(kind, ())):
            return kind
        if kind == "name" and person and (name == "name" or "_name" in name):
            return kind
    return "free_text" if long_text and mode != "hipaa" and any(w in name for w in FREE_TEXT) else "safe"


def strategy(kind: str, mode: str = "strict") -> str:
    """How to mask a category: under hipaa links stay, and quasi-identifiers are generalized under strict only."""
    if (kind == "url" and mode == "hipaa") or (kind == "quasi" and mode != "strict"):
        return "preserve"
    return STRATEGIES[kind]


def scan(df: DataFrame, column: str) -> DataFrame:
    """category, hits, share of non-null values (4 places), found, action: all patterns in one pass over all rows."""
    v = F.col(column)
    hits = [F.count_if(has(v, patterns)).alias(kind) for kind, (patterns, _, _) in VALUES.items()]
    stacked = ", ".join(f"'{kind}', `{kind}`, {limit}D, '{action}'" for kind, (_, limit, action) in VALUES.items())
    row = df.where(v.isNotNull()).agg(F.count("*").alias("n"), *hits)
    share = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    # Free text is long, so a value counts in half as many rows.
    out = row.select("n", F.expr(f"stack({len(VALUES)}, {stacked}) AS (category, hits, threshold, action)"))
    return out.select("category", "hits", places(share, 4).alias("share"), (share >= F.col("threshold") * 0.5).alias("found"), "action")


def _scan_sql(source: str, column: str) -> str:
    parts = []
    for kind, (patterns, limit, action) in VALUES.items():
        hits = f"count(*) FILTER (WHERE regexp_matches({column}, {for_sql(patterns)}))"
        parts.append(f"SELECT '{kind}' AS category, {hits} AS hits, {places_sql(f'{hits}::DOUBLE / count(*)', 4)} AS share, {hits}::DOUBLE / count(*) >= {limit} * 0.5 AS found, '{action}' AS action FROM {source} WHERE {column} IS NOT NULL")
    return " UNION ALL ".join(parts)


@query("pii_value_scan", _scan_sql("documents", "text"))
def pii_value_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), "text")


@query("contains_pii", "SELECT doc_id, " + " || ".join(f"CASE WHEN regexp_matches(text, {for_sql(p)}) THEN '{k},' ELSE '' END" for k, (p, _, _) in VALUES.items()) + " AS categories FROM documents")
def contains_pii(spark, sf_dir):
    """Every document with the categories whose pattern occurs in it."""
    found = F.concat(*(F.when(has(F.col("text"), p), f"{k},").otherwise("") for k, (p, _, _) in VALUES.items()))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("categories"))


@query("hipaa18_coverage", f"SELECT count(*) FILTER (WHERE found) AS n_found, floor(100.0 * count(*) FILTER (WHERE found) / 18 + 0.5)::BIGINT AS pct FROM ({_scan_sql('documents', 'text')}) s WHERE category IN (" + ", ".join(f"'{k}'" for k in COVERS) + ")")
def hipaa18_coverage(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"), "text").where(F.col("category").isin(*COVERS))
    return found.agg(F.count_if("found").alias("n_found")).select("n_found", F.floor(100.0 * F.col("n_found") / len(HIPAA_18) + 0.5).alias("pct"))


#: Keys and references of each table, which are never personal.
KEYS = {t: frozenset([star.PRIMARY_KEYS.get(t)]) | frozenset(c for child, c, _, _ in star.FOREIGN_KEYS if child == t) for t in TABLES}


def _category_sql() -> str:
    """The same rules in SQL, over lower-case names ``c`` of tables ``t``."""
    some = lambda values: ", ".join(f"'{v}'" for v in values)
    keys = " OR ".join(f"(t = '{t}' AND c IN ({some(k - {None})}))" for t, k in KEYS.items() if k - {None})
    out = f"CASE WHEN {keys} THEN 'safe'"
    for kind, names in NAMES.items():
        tests = [f"c IN ({some(names)})", *(f"contains(c, '{part}')" for part in CONTAINED.get(kind, ()))]
        if kind == "name":
            tests.append(f"(t IN ({some(PERSON_TABLES)}) AND (c = 'name' OR contains(c, '_name')))")
        out += f" WHEN {' OR '.join(tests)} THEN '{kind}'"
    return out + " ELSE 'safe' END"


_CATEGORIES = f"SELECT t AS \"table\", c AS \"column\", {_category_sql()} AS category FROM (SELECT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})) n"


@query("pii_columns", f"SELECT \"table\", \"column\", category, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STRATEGIES.items()) + f" END AS strategy FROM ({_CATEGORIES}) c")
def pii_columns(spark, sf_dir):
    """Category and masking strategy of every column of all tables, by names alone; no rows are read."""
    rows = []
    for t in TABLES:
        for c in table(spark, sf_dir, t).columns:
            kind = category(c, KEYS[t], "strict", t)
            rows.append((t, c, kind, strategy(kind)))
    return spark.createDataFrame(rows, "table string, column string, category string, strategy string")


def mask_table(df: DataFrame, name: str, key: str, keys: frozenset[str] = frozenset(), mode: str = "strict", seed: int = 17) -> DataFrame:
    """A table with each column masked by the strategy of its detected category; keys and safe columns stay."""
    out = []
    for field in df.schema:
        plan = strategy(category(field.name, keys | {key}, mode, name), mode)
        if (plan == "shift_date") != (field.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")) and plan in ("shift_date", "generalize_numeric"):
            plan = "redact"  # a date kept as text can't be shifted
        if plan == "generalize_numeric" and not isinstance(field.dataType, NumericType):
            plan = "redact"
        out.append(mask(F.col(field.name), plan, F.col(key), seed).alias(field.name))
    return df.select(*out)


def pick_name(u: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.floor(u * len(names)) + 1).cast("int"))


FIRST = ("Alex", "Blair", "Casey", "Dana", "Eli", "Frankie", "Gray", "Harper", "Indra", "Jules", "Kai", "Lee", "Morgan", "Noel", "Oakley", "Perry")
LAST = ("Abbott", "Barnes", "Carver", "Doyle", "Ellis", "Foster", "Garner", "Hayes", "Irwin", "Jensen", "Keller", "Lowe", "Mercer", "Nolan", "Osborn", "Porter")


def mask(value: Column, strategy: str, key: Column, seed: int = 17) -> Column:
    """A value masked by a strategy; null stays null, and equal keys give equal results."""
    u = lambda k: uniform(seed, "mask", strategy, key, k)
    digits = lambda k, n: F.lpad(F.floor(u(k) * 10**n).cast("long").cast("string"), n, "0")
    out = {
        "replace_name": lambda: F.concat_ws(" ", pick_name(u(0), list(FIRST)), pick_name(u(1), list(LAST))),
        "replace_email": lambda: F.concat(F.lit("user"), digits(0, 6), F.lit("@"), F.coalesce(F.nullif(F.regexp_extract(value, "@(.+)$", 1), F.lit("")), F.lit("example.com"))),
        "replace_phone": lambda: F.concat(F.lit("555-"), digits(0, 3), F.lit("-"), digits(1, 4)),
        "replace_address": lambda: F.concat((F.floor(u(0) * 9899) + 100).cast("string"), F.lit(" "), pick_name(u(1), list(LAST)), F.lit(" St")),
        "replace_username": lambda: F.concat(F.lit("user_"), F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8)),
        "replace_ip": lambda: F.concat_ws(".", F.lit("10"), *(F.floor(u(k) * 256).cast("string") for k in range(3))),
        "replace_url": lambda: F.concat(F.lit("https://example.com/"), F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8)),
        "replace_ssn": lambda: F.concat(F.lit("900-"), digits(0, 2), F.lit("-"), digits(1, 4)),
        "shift_date": lambda: value + F.make_interval(days=((30 + F.floor(u(0) * 336)) * F.when(u(1) < 0.5, -1).otherwise(1) / 7).cast("int") * 7),
        "generalize_numeric": lambda: F.floor(value * (0.9 + 0.2 * u(0)) * 100 + 0.5) / 100,
        "replace_text": lambda: F.concat(F.lit("text-"), F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 12)),
        "redact": lambda: F.lit("[REDACTED]"),
        "preserve": lambda: value,
    }[strategy]()
    return F.when(value.isNotNull(), out)


def _m(strategy: str, k: int = 0) -> str:
    return uniform_sql(17, "mask", strategy, "c_custkey", k)


_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


_NAME_SQL = f"{_LIST(FIRST)}[floor({_m('replace_name', 0)} * 16)::INT + 1] || ' ' || {_LIST(LAST)}[floor({_m('replace_name', 1)} * 16)::INT + 1]"


@query(
    "mask_columns",
    f"""SELECT c_custkey, {_NAME_SQL} AS c_name, c_nationkey,
 floor(c_acctbal * (0.9::DOUBLE + 0.2::DOUBLE * {_m('generalize_numeric')}) * 100 + 0.5) / 100 AS c_acctbal, '[REDACTED]' AS c_mktsegment,
 '555-' || lpad(floor({_m('replace_phone', 0)} * 1000)::BIGINT::VARCHAR, 3, '0') || '-' || lpad(floor({_m('replace_phone', 1)} * 10000)::BIGINT::VARCHAR, 4, '0') AS phone FROM customer""",
)
def mask_columns(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", mask(F.col("c_name"), "replace_name", key).alias("c_name"), "c_nationkey", mask(F.col("c_acctbal"), "generalize_numeric", key).alias("c_acctbal"), mask(F.col("c_mktsegment"), "redact", key).alias("c_mktsegment"), mask(F.lit("x"), "replace_phone", key).alias("phone")
    )


@query("mask_detected", f"SELECT c_custkey, {_NAME_SQL} AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_detected(spark, sf_dir):
    """The customer table masked by what its column names tell: the names are replaced, the rest stays."""
    return mask_table(table(spark, sf_dir, "customer"), "customer", "c_custkey", KEYS["customer"]).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def token(prefix: str, tbl: str, column: str) -> Column:
    """The same value of a table's column always gives the same token."""
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws(":", F.lit(tbl), F.lit(column), F.col(column).cast("string")), 256), 1, 12)))


_TOKEN = "'name-' || substr(sha256('customer:c_name:' || c_name), 1, 12)"


@query("tokenize", f"SELECT c_custkey, {_TOKEN} AS c_name FROM customer")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", token("name", "customer", "c_name").alias("c_name"))


@query("token_map", f"SELECT DISTINCT {_TOKEN} AS token, c_name AS original FROM customer")
def token_map(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(token("name", "customer", "c_name").alias("token"), F.col("c_name").alias("original")).distinct()


@query("detokenize", "SELECT c_custkey, c_name FROM customer")
def detokenize(spark, sf_dir):
    """Tokens turned back by the map; an unknown token stays."""
    tokens, names = tokenize(spark, sf_dir), token_map(spark, sf_dir)
    return tokens.join(names, tokens.c_name == names.token, "left").select("c_custkey", F.coalesce("original", "c_name").alias("c_name"))


@query("deep_scan", f"SELECT category, share FROM ({_scan_sql('conversations', 'text')}) s WHERE hits > 0 ORDER BY share DESC, category LIMIT 1")
def deep_scan(spark, sf_dir):
    """The scanner with most hits in a free-text column that its name calls safe."""
    return scan(table(spark, sf_dir, "conversations"), "text").where("hits > 0").orderBy(F.col("share").desc(), "category").select("category", "share").limit(1)


def audit_chain(entries: list[dict], genesis: str = "0" * 64) -> list[dict]:
    """Entries with hash and previous hash; changing any entry breaks all later hashes."""
    out, last = [], genesis
    for entry in entries:
        digest = hashlib.sha256((last + json.dumps(entry, sort_keys=True)).encode()).hexdigest()
        out.append(entry | {"previous": last, "hash": digest})
        last = digest
    return out


def audit_verified(chain: list[dict], genesis: str = "0" * 64) -> bool:
    plain = [{k: v for k, v in e.items() if k not in ("previous", "hash")} for e in chain]
    return audit_chain(plain, genesis) == chain


def encrypt(value: Column, passphrase: str, salt: bytes = b"datumloom") -> Column:
    """AES-256 in GCM mode under a key from PBKDF2 (SHA-512, 100,000 rounds)."""
    return F.base64(F.aes_encrypt(value, F.lit(hashlib.pbkdf2_hmac("sha512", passphrase.encode(), salt, 100_000, 32)), F.lit("GCM")))


def decrypt(value: Column, passphrase: str, salt: bytes = b"datumloom") -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(hashlib.pbkdf2_hmac("sha512", passphrase.encode(), salt, 100_000, 32)), F.lit("GCM")).cast("string")
