"""A query for every transform of the language, over lineitem, documents or embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.features import FeatureSet
from tessella.queries.base import LINE, dense_rows, float_rows, lines, query, string_rows, table
from tessella.transforms import build

COLUMN = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}
SELECT = "SELECT l_orderkey, l_linenumber, "


def q(x: str, d: float) -> str:
    return f"(CAST({d} AS DOUBLE) * CAST(trunc({x} / CAST({d} AS DOUBLE)) AS BIGINT))"


def s(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


def strings_sql(*names: str, where: str = "") -> str:
    return " UNION ALL ".join(f"{SELECT}{n} AS feature FROM lineitem {where}" for n in names)


def floats_sql(*pairs: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"{SELECT}{n} AS feature, {v} AS value FROM lineitem" for n, v in pairs)


def case(name: str, config: dict, family: str, sql: str, kind: str = "s") -> None:
    """Register a query that runs one transform over ``lines`` and returns a family's rows."""
    config = {"transform": name.split("__")[0], **config}

    def run(spark, sf_dir):
        fs = build(config)(lines(spark, sf_dir))
        return {"s": string_rows, "f": float_rows, "d": dense_rows}[kind](fs, family)

    query(f"transform_{name}", sql)(run)


def raw(k: str) -> tuple[str, str]:
    return f"'{k}'", COLUMN[k]


# strings
case("convert_string_case", {"field1": "flag", "convert_to_uppercase": False, "output": "low"}, "low", strings_sql("lower(l_returnflag)"))
case("replace_all_strings", {"field1": "ship", "replacements": [{"(\\d+)-(\\d+)-(\\d+)": "$3/$2/$1"}, {"/": "."}], "output": "out"}, "out", strings_sql("strftime(l_shipdate, '%d.%m.%Y')"))
case("cross", {"field1": "flag", "field2": "status", "output": "x"}, "x", strings_sql("l_returnflag || '^' || l_linestatus"))
case("cross__keys", {"field1": "flag", "field2": "status", "output": "x", "keys1": ["R"], "keys2": ["F"]}, "x", strings_sql("'R^F'", where="WHERE l_returnflag = 'R' AND l_linestatus = 'F'"))
case("delete_string_feature", {"field1": "ship", "keys": ["1995", "1996-0"]}, "ship", strings_sql("strftime(l_shipdate, '%Y-%m-%d')", where="WHERE NOT (strftime(l_shipdate, '%Y-%m-%d') LIKE '1995%' OR strftime(l_shipdate, '%Y-%m-%d') LIKE '1996-0%')"))
case("stump", {"stumps": ["loc,qty,25,many", "loc,disc,0.05,cheap"], "output": "st"}, "st", strings_sql("'many'", where="WHERE l_quantity >= 25") + " UNION ALL " + strings_sql("'cheap'", where="WHERE l_discount >= 0.05"))
case("string_cross_float", {"field1": "flag", "field2": "loc", "keys2": ["qty", "tax"], "output": "x"}, "x", floats_sql(("l_returnflag || '^qty'", "l_quantity"), ("l_returnflag || '^tax'", "l_tax")), "f")
for part, sql in {"day_of_month": "day", "day_of_week": "dayofweek", "day_of_year": "dayofyear", "year": "year", "month": "month"}.items():
    plus = " + 1" if part == "day_of_week" else ""
    case(f"date_val__{part}", {"field1": "ship", "date_type": part, "output": "dv"}, "dv", floats_sql(("strftime(l_shipdate, '%Y-%m-%d')", f"CAST({sql}(l_shipdate){plus} AS DOUBLE)")), "f")
case("date_diff", {"field1": "due", "field2": "ship", "output": "dd"}, "dd", floats_sql(("strftime(CAST(l_shipdate AS DATE) + 30, '%Y-%m-%d') || '-m-' || strftime(l_shipdate, '%Y-%m-%d')", "30.0::DOUBLE")), "f")

# floats
case("cap_float", {"field1": "loc", "keys": ["qty", "price"], "lower_bound": 10, "upper_bound": 40, "output": "cap"}, "cap", floats_sql(*[(f"'{k}'", f"least(greatest({COLUMN[k]}, 10.0::DOUBLE), 40.0::DOUBLE)") for k in ("qty", "price")]), "f")
case("coalesce_float", {"field1": "loc", "keys": ["qty", "none"], "value": 7.5, "output": "co"}, "co", floats_sql(("'none'", "7.5::DOUBLE")), "f")
case("cut_float", {"field1": "loc", "keys": ["qty"], "lower_bound": 10, "upper_bound": 40, "output": "cut"}, "cut", f"{SELECT}'qty' AS feature, l_quantity AS value FROM lineitem WHERE l_quantity BETWEEN 10 AND 40", "f")
case("cut_float__in_place", {"field1": "loc", "keys": ["qty"], "upper_bound": 40}, "loc", floats_sql(raw("price"), raw("disc"), raw("tax")) + f" UNION ALL {SELECT}'qty', l_quantity FROM lineitem WHERE l_quantity <= 40", "f")
for f in ("log10", "log", "abs", "sin", "cos"):
    value = "round({}({}), 9)".format("ln" if f == "log" else f, "l_tax")
    where = " WHERE l_tax > 0" if f in ("log10", "log") else ""

    def math_case(f=f, value=value, where=where):
        config = {"transform": "math_float", "field1": "loc", "keys": ["tax"], "function": f, "output": "m"}
        query(f"transform_math_float__{f}", f"{SELECT}'tax' AS feature, {value} AS value FROM lineitem{where}")(lambda spark, d: float_rows(build(config)(lines(spark, d)), "m").withColumn("value", F.round("value", 9)))

    math_case()
query("transform_normalize_float", "WITH n AS (SELECT *, sqrt(l_quantity*l_quantity + l_extendedprice*l_extendedprice + l_discount*l_discount + l_tax*l_tax) AS n FROM lineitem) " + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{k}' AS feature, round({c} / n, 9) AS value FROM n" for k, c in COLUMN.items()))(
    lambda spark, d: float_rows(build({"transform": "normalize_float", "field1": "loc"})(lines(spark, d)), "loc").withColumn("value", F.round("value", 9))
)
case("divide", {"field1": "loc", "keys": ["price"], "field2": "loc", "key2": "qty", "constant": 0.5, "output": "dv"}, "dv", floats_sql(("'price-d-qty'", "l_extendedprice / (l_quantity + 0.5)")), "f")
case("subtract", {"field1": "loc", "keys": ["disc", "tax"], "field2": "loc", "key2": "qty", "output": "su"}, "su", floats_sql(("'disc-qty'", "l_discount - l_quantity"), ("'tax-qty'", "l_tax - l_quantity")), "f")
case("product", {"field1": "loc", "keys": ["disc", "tax", "none"], "output": "pr"}, "pr", floats_sql(("'*'", "1.0::DOUBLE * (1 + l_discount) * (1 + l_tax)")), "f")
case("approximate_percentile", {"field1": "loc", "low": "tax", "upper": "qty", "field2": "loc", "key2": "disc", "minDiff": 2.0, "output": "ap", "outputKey": "p"}, "ap", f"{SELECT}'p' AS feature, CASE WHEN l_discount <= l_tax THEN 0.0::DOUBLE WHEN l_discount >= l_quantity THEN 1.0::DOUBLE ELSE (l_discount - l_tax) / (l_quantity - l_tax) END AS value FROM lineitem WHERE l_quantity - l_tax >= 2.0", "f")
case("stuff_id", {"field1": "loc", "key1": "qty", "field2": "loc", "key2": "price", "output": "si"}, "si", floats_sql(("'price@' || CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)", "l_extendedprice")), "f")
case("float_label", {"field1": "loc", "key1": "qty", "threshold": 25, "merge": "skip"}, "LABEL", floats_sql(("''", "CASE WHEN l_quantity >= 25 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END")), "f")
case("delete_float_feature", {"field1": "loc", "keys": ["price", "disc"]}, "loc", floats_sql(raw("qty"), raw("tax")), "f")
case("nearest", {"field1": "loc", "field2": "loc", "key": "disc", "output": "ne"}, "ne", strings_sql("'disc~=disc'"))
case("float_cross_float", {"field1": "loc", "bucket": 1000, "field2": "loc", "cap": 20000, "output": "ff"}, "ff", " UNION ALL ".join(f"{SELECT}'{a}=' || {s(q(f'least({ca}, 20000.0::DOUBLE)', 1000))} || '^{b}' AS feature, {cb} AS value FROM lineitem" for a, ca in COLUMN.items() for b, cb in COLUMN.items()), "f")

# quantisers
case("quantize", {"field1": "loc", "scale": 10, "output": "qu"}, "qu", strings_sql(*[f"'{k}=' || CAST(CAST(trunc({c} * 10.0::DOUBLE) AS BIGINT) AS VARCHAR)" for k, c in COLUMN.items()]))
multi = lambda keys: " UNION ALL ".join(strings_sql(f"CASE WHEN {COLUMN[k]} = 0 THEN '{k}=0' ELSE '{k}[{b}]=' || {s(q(COLUMN[k], b))} END", where=f"WHERE {COLUMN[k]} <> 0" if b > 1 else "") for k in keys for b in (1.0, 10.0))
case("multiscale_quantize", {"field1": "loc", "buckets": [1, 10], "output": "ms"}, "ms", multi(COLUMN))
case("custom_multiscale_quantize", {"field1": "loc", "buckets": [1, 10], "select_features": ["qty", "price"], "exclude_features": ["price"], "output": "ms"}, "ms", multi(["qty"]))
ladder = ((1.0, 0.03125), (10.0, 0.125), (25.0, 0.25), (50.0, 5.0), (100.0, 10.0), (400.0, 25.0), (2000.0, 100.0), (10000.0, 250.0))
log_case = lambda k, c: f"'{k}=' || CASE WHEN {c} < 0.01 THEN '0' " + " ".join(f"WHEN {c} <= {lim} THEN " + (s(q(c, st)) if lim <= 25 else f"CAST(CAST({q(c, st)} AS BIGINT) AS VARCHAR)") for lim, st in ladder) + f" ELSE CAST(1 << CAST(floor(ln({c}) / ln(2.0::DOUBLE)) AS BIGINT) AS VARCHAR) END"
case("linear_log_quantize", {"field1": "loc", "output": "ll"}, "ll", strings_sql(*[log_case(k, c) for k, c in COLUMN.items()]))
steps = ((1.0, 0.125), (10.0, 0.5), (100.0, 5.0), (10000.0, 250.0))
custom = lambda k, c: f"'{k}=' || CASE WHEN {c} < 0.01 THEN '0.0' " + " ".join(f"WHEN {c} < {lim} THEN {s(f'CAST(trunc({q(c, st)} * 1000) AS BIGINT) / 1000.0::DOUBLE')}" for lim, st in steps) + " ELSE '10000.0' END"
case("custom_linear_log_quantize", {"field1": "loc", "limit_bucket": [{"1": 0.125}, {"10": 0.5}, {"100": 5}, {"10000": 250}], "output": "cl"}, "cl", strings_sql(*[custom(k, c) for k, c in COLUMN.items()]))
case("custom_range_quantize", {"field1": "loc", "thresholds": [7, 28], "select_features": ["qty"], "output": "cr"}, "cr", strings_sql("CASE WHEN l_quantity <= 7 THEN 'qty<=7.0' WHEN l_quantity <= 28 THEN '7.0<qty<=28.0' ELSE 'qty>28.0' END"))
case("bucket_float", {"field1": "loc", "bucket": 5.0, "output": "bf"}, "bf", floats_sql(*[(f"'{k}[5.0]=' || {s(q(c, 5.0))}", f"{c} - {q(c, 5.0)}") for k, c in COLUMN.items()]), "f")
case("float_to_string", {"field1": "loc", "keys": ["qty"], "values": [1, 2, 3], "string_output": "fs"}, "fs", strings_sql(f"'qty=' || {s('l_quantity')}", where="WHERE l_quantity IN (1, 2, 3)"))
case("float_to_string__left", {"field1": "loc", "keys": ["qty"], "values": [1, 2, 3], "string_output": "fs"}, "loc", floats_sql(raw("price"), raw("disc"), raw("tax")) + f" UNION ALL {SELECT}'qty', l_quantity FROM lineitem WHERE l_quantity NOT IN (1, 2, 3)", "f")
case("move_float_to_string", {"field1": "loc", "keys": ["qty"], "bucket": 5, "cap": 30, "output": "mv"}, "mv", strings_sql(f"'qty=' || {s(q('least(l_quantity, 30.0::DOUBLE)', 5))}"))
case("move_float_to_string__left", {"field1": "loc", "keys": ["qty"], "bucket": 5, "output": "mv"}, "loc", floats_sql(raw("price"), raw("disc"), raw("tax")), "f")
two = {"field1": "loc", "keys": ["qty", "price"], "bucket": 1, "min_bucket": 0, "max_bucket": 10, "string_output": "so", "float_output": "fo"}
inside = " UNION ALL ".join(f"{SELECT}'{k}=' || {s(q(COLUMN[k], 1))} AS feature FROM lineitem WHERE {q(COLUMN[k], 1)} BETWEEN 0 AND 10" for k in ("qty", "price"))
outside = " UNION ALL ".join(f"{SELECT}'{k}' AS feature, {COLUMN[k]} AS value FROM lineitem WHERE {q(COLUMN[k], 1)} NOT BETWEEN 0 AND 10" for k in ("qty", "price"))
case("move_float_to_string_and_float", two, "so", inside)
case("move_float_to_string_and_float__floats", two, "fo", outside, "f")
case("multiscale_move_float_to_string", {"field1": "loc", "keys": ["qty"], "buckets": [1, 10], "output": "mm"}, "mm", strings_sql(*[f"'qty[{b}]=' || {s(q('l_quantity', b))}" for b in (1.0, 10.0)]))
cell = lambda b: f"'[{b}]=(' || {s(q('l_quantity', b))} || ',' || {s(q('l_extendedprice', b))} || ')'"
grid = {"field1": "loc", "value1": "qty", "value2": "price", "buckets": [5, 100], "output": "g"}
case("multiscale_grid_quantize", grid, "g", strings_sql(cell(5.0), cell(100.0)))
case("multiscale_grid_continuous", grid, "g", floats_sql(*[x for b in (5.0, 100.0) for x in ((f"{cell(b)} || '@1'", f"l_quantity - {q('l_quantity', b)}"), (f"{cell(b)} || '@2'", f"l_extendedprice - {q('l_extendedprice', b)}"))]), "f")

# trees and vectors
NODES = [
    {"type": "x", "split": 25.0, "left": 1, "right": 2}, {"type": "leaf"}, {"type": "y", "split": 40000.0, "left": 3, "right": 4}, {"type": "leaf"}, {"type": "leaf"},
]
kd = {"field1": "loc", "value1": "qty", "value2": "price", "max_count": 2, "output": "kd", "nodes": NODES}
path = "SELECT l_orderkey, l_linenumber, unnest(CASE WHEN l_quantity < 25 THEN ['1', '0'] WHEN l_extendedprice < 40000 THEN ['3', '2'] ELSE ['4', '2'] END) AS feature FROM lineitem"
case("kdtree", kd, "kd", path)
case("kdtree_continuous", kd, "kd", f"{SELECT}'0' AS feature, l_quantity - 25.0 AS value FROM lineitem WHERE l_quantity < 25 UNION ALL {SELECT}'2', l_extendedprice - 40000.0 FROM lineitem WHERE l_quantity >= 25", "f")
TREE = ["P,0,loc,qty,25,1,2", "L,1,-0.5,few", "P,2,loc,disc,0.05,3,4", "L,3,0.25,dear", "L,4,0.75,cheap"]
dt = {"nodes": TREE, "output_leaves": "leaf", "output_score_family": "ts", "output_score_name": "t"}
case("decision_tree", dt, "leaf", strings_sql("CASE WHEN l_quantity < 25 THEN 'few' WHEN l_discount < 0.05 THEN 'dear' ELSE 'cheap' END"))
case("decision_tree__score", dt, "ts", floats_sql(("'t'", "CASE WHEN l_quantity < 25 THEN -0.5::DOUBLE WHEN l_discount < 0.05 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END")), "f")
case("float_to_dense", {"fields": ["loc", "loc"], "keys": ["qty", "tax"]}, "qty^tax", f"{SELECT}0 AS pos, l_quantity AS value FROM lineitem UNION ALL {SELECT}1, l_tax FROM lineitem", "d")
two_d = " UNION ALL ".join(f"{SELECT}'{a}^{b}' AS feature, {COLUMN[a]} AS x, {COLUMN[b]} AS y FROM lineitem" for a in COLUMN for b in COLUMN if a < b)


@query("transform_float_family_cross_to_two_d_dense", two_d)
def two_d_dense(spark, sf_dir):
    fs = build({"transform": "float_family_cross_to_two_d_dense", "field1": "loc"})(lines(spark, sf_dir))
    return fs.df.select(*LINE, F.explode("dense_pairs").alias("feature", "v")).select(*LINE, "feature", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query("transform_list", f"{SELECT}'qty=' || {s(q('l_quantity * 1.0', 5))} || '^' || lower(l_returnflag) AS feature FROM lineitem")
def listed(spark, sf_dir):
    config = {
        "transform": "list",
        "transforms": [
            {"transform": "convert_string_case", "field1": "flag", "convert_to_uppercase": False},
            {"transform": "move_float_to_string", "field1": "loc", "keys": ["qty"], "bucket": 5, "output": "b"},
            {"transform": "cross", "field1": "b", "field2": "flag", "output": "x"},
        ],
    }
    return string_rows(build(config)(lines(spark, sf_dir)), "x")


@query("transform_delete_families", f"{SELECT}len(['qty']) AS n FROM lineitem")
def deleted(spark, sf_dir):
    fs = build({"transform": "list", "transforms": [{"transform": "delete_string_feature_family", "fields": ["flag"]}, {"transform": "delete_string_feature_column", "fields": ["status"]}, {"transform": "delete_float_feature_family", "fields": ["none"]}]})(lines(spark, sf_dir))
    return fs.df.select(*LINE, F.lit(len(fs.float_families)).cast("long").alias("n"))


def documents(spark, sf_dir) -> FeatureSet:
    return FeatureSet(table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("s:text"), F.array(F.concat(F.lit("l:"), F.col("lang")), F.concat(F.lit("s:"), F.col("source")), F.lit("all")).alias("s:meta")))


WORDS = r"[^a-zA-Z]+"
SPLIT = r"list_filter(string_split_regex(text, '[^a-zA-Z]+'), lambda t: len(t) > 0)"


@query("transform_default_string_tokenizer", f"SELECT doc_id, t AS feature, CAST(count(*) AS DOUBLE) AS value FROM (SELECT doc_id, unnest({SPLIT}) AS t FROM documents) GROUP BY ALL")
def tokens(spark, sf_dir):
    fs = FeatureSet(table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("s:text")))
    return float_rows(build({"transform": "default_string_tokenizer", "field1": "text", "regex": WORDS, "output": "tok"})(fs), "tok", ["doc_id"])


@query("transform_ngram", f"WITH t AS (SELECT doc_id, {SPLIT} AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i]), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM t) SELECT doc_id, f AS feature, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY ALL")
def ngrams(spark, sf_dir):
    fs = FeatureSet(table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("s:text")))
    return float_rows(build({"transform": "ngram", "field1": "text", "regex": WORDS, "n": 2, "min_n": 1, "output": "g"})(fs), "g", ["doc_id"])


@query("transform_self_cross", "SELECT doc_id, unnest(['all^l:' || lang, 'all^s:' || source, 'l:' || lang || '^s:' || source]) AS feature FROM documents")
def self_crossed(spark, sf_dir):
    return string_rows(build({"transform": "self_cross", "field1": "meta", "output": "x"})(documents(spark, sf_dir)), "x", ["doc_id"])


@query("transform_normalize_utf8", "SELECT doc_id, nfc_normalize(text) AS feature FROM documents WHERE text IS NOT NULL")
def normal(spark, sf_dir):
    fs = FeatureSet(table(spark, sf_dir, "documents").select("doc_id", F.array("text").alias("s:n")).where("text IS NOT NULL"))
    return string_rows(build({"transform": "normalize_utf8", "field1": "n", "normalization_form": "NFC", "output": "o"})(fs), "o", ["doc_id"])


@query("transform_wta")
def winners(spark, sf_dir):
    fs = FeatureSet(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("d:e")))
    return string_rows(build({"transform": "wta", "field_names": ["e"], "output": "w", "seed": 1234, "num_words_per_feature": 4, "num_tokens_per_word": 4, "sizes": {"e": 64}})(fs), "w", ["vec_id"])
