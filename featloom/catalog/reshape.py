"""Reshaping, names, value recoding and name matching."""

from pyspark.sql import functions as F

from ..functions.names import decode_names, encode_names
from ..functions.nested import rename_values, select_nested_fields
from ..operators import matching, reshape
from .base import query

# Everything that Python's strip() removes, as a character class of DuckDB's regex.
_SQL_STRIP = r"regexp_replace({0}, '^[\s\v\pZ\x{{1c}}-\x{{1f}}\x{{85}}]+|[\s\v\pZ\x{{1c}}-\x{{1f}}\x{{85}}]+$', '', 'g')"


@query("zip_explode", """
SELECT l_orderkey, l_linenumber, len(names) AS n, item.field AS field, item.value AS value FROM (
  SELECT l_orderkey, l_linenumber, ['quantity', 'price', 'tax', 'rest'] AS names,
    {'field': 'quantity', 'value': l_quantity} AS item FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, ['', '', '', ''], {'field': 'price', 'value': l_extendedprice} FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, ['', '', '', ''], {'field': 'tax', 'value': l_tax} FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, ['', '', '', ''], {'field': 'rest', 'value': NULL} FROM lineitem)""")
def zip_explode(t):
    """Arrays of 4 and 3 elements: the shorter is padded, the sources stay."""
    arrays = t("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array(*map(F.lit, ("quantity", "price", "tax", "rest"))).alias("names"),
        F.array("l_quantity", "l_extendedprice", "l_tax").alias("values"))
    zipped = reshape.zip_explode_cols(arrays, ["names", "values"], "item", {"names": "field", "values": "value"})
    return zipped.select("l_orderkey", "l_linenumber", F.size("names").cast("bigint").alias("n"),
                         F.col("item.field").alias("field"), F.col("item.value").alias("value"))


@query("zip_explode_drop", """
SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INT) AS position,
  round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings""")
def zip_explode_drop(t):
    arrays = t("embeddings").withColumn("position", F.sequence(F.lit(0), F.size("embedding") - 1))
    zipped = reshape.zip_explode_cols(arrays, ["position", "embedding"], "cell", {"embedding": "value"},
                                      drop_sources=True, outer=True, strict=True)
    return zipped.select(*[c for c in zipped.columns if c != "cell"], "cell.position",
                         F.round(F.col("cell.value").cast("double"), 6).alias("value"))


@query("nested_select", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS "event.props.k", value AS "event.value.raw",
  event_type AS "event.kind.name" FROM events""")
def nested_select(t):
    nested = t("events").select(
        "event_id",
        F.struct(F.from_json("props", "k int").alias("props"), F.col("value").alias("value.raw"),
                 F.create_map(F.lit("name"), F.col("event_type")).alias("kind")).alias("event"))
    spec = ["event_id", {"event": [{"props": ["k"]}, "value.raw", {"kind": "name"}]}]
    return nested.select(*(column for _, column in select_nested_fields(spec)))


@query("flatten_struct", """
SELECT o_orderkey, o_custkey AS "buyer.key", o_orderpriority AS "buyer.how.priority",
  o_totalprice AS "price%20in%20USD" FROM orders""")
def flatten_struct(t):
    packed = t("orders").select(
        "o_orderkey",
        F.struct(F.col("o_custkey").alias("key"),
                 F.struct(F.col("o_orderpriority").alias("priority")).alias("how")).alias("buyer"),
        F.col("o_totalprice").alias("price in USD"))
    return reshape.flatten(packed)


@query("flatten_array", """
SELECT l_orderkey, l_linenumber, 2::BIGINT AS n, l_quantity AS q1, l_tax AS q2,
  l_extendedprice AS p11, l_discount AS p12, l_partkey AS p21 FROM lineitem""")
def flatten_array(t):
    """Two array levels; the elements are taken out again for the comparison."""
    def part(*prices):
        return F.array(*(F.struct(F.col(p).cast("double").alias("price")) for p in prices))

    packed = t("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(F.array(F.struct(F.col("l_quantity").alias("q"), part("l_extendedprice", "l_discount").alias("part")),
                         F.struct(F.col("l_tax").alias("q"), part("l_partkey").alias("part"))).alias("items")).alias("s"))
    flat = reshape.flatten(packed)
    q, price = F.col("`s.items_q`"), F.col("`s.items_part_price`")
    return flat.select("l_orderkey", "l_linenumber", F.size(q).cast("bigint").alias("n"), q[0].alias("q1"), q[1].alias("q2"),
                       price[0][0].alias("p11"), price[0][1].alias("p12"), price[1][0].cast("bigint").alias("p21"))


@query("normalise_fields", """
SELECT c_custkey AS "cust%40key", c_name AS "full%20name", c_acctbal AS "in%20USD", c_mktsegment AS "seg%2Bment"
FROM customer""")
def normalise_fields(t):
    raw = t("customer").select(
        F.col("c_custkey").alias(" cust@key "), F.col("c_name").alias("full name"),
        F.struct(F.col("c_acctbal").alias("in USD"), F.col("c_mktsegment").alias("seg+ment")).alias("more@"))
    named = reshape.normalise_fields_names(raw)
    return named.select("`cust%40key`", "`full%20name`", *(
        F.col("`more%40`").getField(f).alias(f) for f in ("in%20USD", "seg%2Bment")))


@query("url_encode_names", f"""
SELECT doc_id, md5(replace(url_encode({_SQL_STRIP.format('text')}), '%2F', '/')) AS encoded,
  length(replace(url_encode({_SQL_STRIP.format('text')}), '%2F', '/')) AS n FROM documents""")
def url_encode_names(t):
    """Whole document texts as names: every character class occurs."""
    encoded = t("documents").select("doc_id", encode_names("text").alias("e"))
    return encoded.select("doc_id", F.md5("e").alias("encoded"), F.length("e").cast("bigint").alias("n"))


@query("url_decode_names", f"""
SELECT doc_id, md5(url_decode(replace({_SQL_STRIP.format('url_encode(text)')}, '%2F', '/'))) AS decoded FROM documents""")
def url_decode_names(t):
    """Decoding gives back the text that was encoded."""
    escaped = F.regexp_replace(F.regexp_replace(F.url_encode("text"), r"\+", "%20"), "%2F", "/")
    return t("documents").select("doc_id", F.md5(decode_names(escaped)).alias("decoded"))


@query("url_decode_pages", """
SELECT page_id, url_decode(replace(url, '/', '%2F')) AS url FROM pages""")
def url_decode_pages(t):
    return t("pages").select("page_id", decode_names(F.replace("url", F.lit("/"), F.lit("%2F"))).alias("url"))


_EVENT_WEIGHTS = {"view": 1, "click": 2, "purchase": 10}


@query("rename_values", """
SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 10 END AS weight FROM events""")
def rename_event_types(t):
    return t("events").select("event_id", rename_values("event_type", _EVENT_WEIGHTS).alias("weight"))


@query("rename_values_default", """
SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 10 ELSE 0 END AS weight
FROM events""")
def rename_event_types_default(t):
    return t("events").select("event_id", rename_values("event_type", _EVENT_WEIGHTS, 0).alias("weight"))


@query("rename_values_lookup", """
SELECT p_partkey, CASE WHEN p_partkey % 1000 < 700 THEN 'code ' || p_partkey % 1000 % 7 ELSE 'unknown' END AS code FROM part""")
def rename_part_keys(t):
    codes = {key: f"code {key % 7}" for key in range(700)}
    parts = t("part").select("p_partkey", (F.col("p_partkey") % 1000).alias("code"))
    return reshape.rename_column_values(parts, "code", codes, "unknown")


@query("rename_values_lookup_int", """
SELECT p_partkey, CASE WHEN p_partkey % 1000 < 700 THEN (p_partkey % 1000 % 7)::INT END AS code FROM part""")
def rename_part_keys_int(t):
    """Codes that are integers stay integers, as in a short dictionary."""
    codes = {key: key % 7 for key in range(700)}
    parts = t("part").select("p_partkey", (F.col("p_partkey") % 1000).alias("code"))
    return reshape.rename_column_values(parts, "code", codes)



@query("melt", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax.rate', CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_tax END
FROM lineitem""")
def melt_lineitem(t):
    wide = t("lineitem").withColumn("l_tax.rate", F.when(F.col("l_returnflag") != "N", F.col("l_tax")))
    return reshape.melt(wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax.rate"],
                        "measure", "amount")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(t):
    return reshape.head(t("orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey"))


_SQL_NORM = r"lower(regexp_replace({0}, '\s|_|\(|\)|-', '', 'g'))"


@query("str_normalize", f"SELECT DISTINCT {_SQL_NORM.format('p_name')} AS norm, p_name AS name FROM part")
def str_normalize(t):
    return matching.str_normalize(t("part"), "p_name")


def _spellings(t):
    part = t("part")
    ours = part.select("p_partkey", F.concat_ws(" - ", "p_type", "p_brand").alias("name"))
    theirs = part.select(
        F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.upper("p_type")), F.lit("__("), F.lower("p_brand"), F.lit(")")).alias("name"))
    return ours, theirs


_SPELLINGS_SQL = f"""
WITH ours AS (SELECT p_partkey, p_type || ' - ' || p_brand AS name, {_SQL_NORM.format("p_type || p_brand")} AS norm FROM part),
     theirs AS (SELECT DISTINCT kind || '__(' || lower(p_brand) || ')' AS name, {_SQL_NORM.format("kind || p_brand")} AS norm
                FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN '' ELSE upper(p_type) END AS kind FROM part))
"""


@query("fuzzy_match_names", _SPELLINGS_SQL + """
SELECT norm, a.name AS names_a, b.name AS names_b
FROM (SELECT DISTINCT norm, name FROM ours) a FULL JOIN theirs b USING (norm)""")
def fuzzy_match_names(t):
    return matching.fuzzy_match_names(*_spellings(t))


@query("fuzzy_match_to_reference", _SPELLINGS_SQL + """
SELECT p_partkey, ours.name AS name, theirs.name AS ref_name FROM ours LEFT JOIN theirs USING (norm)""")
def fuzzy_match_to_reference(t):
    ours, theirs = _spellings(t)
    return matching.fuzzy_match_to_reference(theirs, ours)
