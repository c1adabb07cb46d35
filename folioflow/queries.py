"""Registry of the queries over the driver's tables, and of the SQL that gives the same rows.

Each query applies one or more operators to whole tables; those whose subject the tables lack run on the
literal cases below instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import aggregates, filters, joins, layout, marks, repair, segment, translit, windows
from .sources import corpus
from .sources.shared import written
from .sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], columns: str) -> str:
    quote = lambda v: "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) t({columns})"


_WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


# Aggregates


@query(r"""SELECT token, count(*) AS freq FROM (SELECT unnest(list_transform(regexp_extract_all(regexp_replace(text, '<[^>]+>', '', 'g'), '[A-Za-z]+'), lambda x: lower(x))) AS token FROM documents) GROUP BY token""")
def token_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: corpus token frequency."""
    return aggregates.token_frequency(table(spark, sf_dir, "documents"))


@query(r"""SELECT token, example FROM (SELECT lower(x) AS token, arg_min(x, doc_id * 1000000 + i) AS example, min(doc_id * 1000000 + i) AS p FROM
(SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS l FROM documents)) GROUP BY 1) ORDER BY length(example) DESC, p LIMIT 20""")
def longest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which each token is first seen; the twenty longest, in order of first sight (a top-k report)."""
    seen = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("i", "example"))
    rows = seen.select(F.lower("example").alias("token"), "example", F.struct("doc_id", "i").alias("pos"))
    return aggregates.first_examples(rows, "token", "example", "pos").select("token", "example")


@query("""SELECT c_custkey, n_orders, expected, round_even(n_orders / expected * 100, 1)::DOUBLE AS recovery, n_orders / expected < 0.7 AS below FROM
(SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders, (8 + c_custkey % 7)::DOUBLE AS expected FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""")
def counts_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by key beside expected numbers, recovery in percent."""
    counts = aggregates.count_by(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "id"), "id", "n_orders")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (8 + F.col("c_custkey") % 7).cast("double").alias("expected"))
    rows = joins.with_expected(counts, expected)
    return rows.select(F.col("id").alias("c_custkey"), "n_orders", "expected", aggregates.recovery(F.col("n_orders"), F.col("expected")).alias("recovery"), (F.col("n_orders") / F.col("expected") < 0.7).alias("below"))


@query("""SELECT l_orderkey, arg_max(v, c * 100 - p) AS mode FROM (SELECT l_orderkey, v, count(*) AS c, min(p) AS p FROM
(SELECT l_orderkey, round_even(l_quantity / 10, 0)::INT AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS p FROM lineitem) GROUP BY ALL) GROUP BY l_orderkey""")
def first_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the most frequent rounded value, of ties the first."""
    rows = table(spark, sf_dir, "lineitem")
    return aggregates.first_mode(rows, ["l_orderkey"], F.bround(F.col("l_quantity") / 10, 0).cast("int"), ["l_linenumber", "l_quantity"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus <> 'O') AS n_other, max(o_totalprice) AS top, coalesce(min(CASE WHEN o_totalprice > 1e9 THEN o_totalprice END), 0) AS none FROM orders GROUP BY 1")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: conditional counts, extremes with a default."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") != "O").alias("n_other"), F.max("o_totalprice").alias("top"),
        F.coalesce(F.min(F.when(F.col("o_totalprice") > 1e9, F.col("o_totalprice"))), F.lit(0.0)).alias("none"))


@query("SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber)) AS l_linenumbers FROM lineitem GROUP BY 1")
def sorted_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct values by group."""
    return aggregates.sorted_set(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(lang), substring(text, 1, 80) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each composite key."""
    return aggregates.keep_first(table(spark, sf_dir, "documents"), [F.lower("lang"), F.substring("text", 1, 80)], F.col("doc_id")).select("doc_id", "lang", "source")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY 1")
def concat_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered concatenation."""
    rows = table(spark, sf_dir, "conversations").withColumn("p", F.struct("turn", "role", "text"))
    return aggregates.concat_ordered(rows, ["conv_id"], "p", "text").select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


_REGIONS = ["EUROPE", "ASIA", "AMERICA", "AFRICA"]


@query("SELECT i - 1 AS ord, r AS label, count(*) AS books FROM (SELECT unnest(['EUROPE', 'ASIA', 'AMERICA', 'AFRICA']) AS r, unnest([1, 2, 3, 4]) AS i) JOIN region ON r_name = r JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def sections_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in a fixed order, empty ones left out."""
    sections = literal(spark, [(k, r, r) for k, r in enumerate(_REGIONS)], "ord int, key string, label string")
    books = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "section")
    return aggregates.by_section(books, sections)


@query("SELECT i - 1 AS ord, n_name, (row_number() OVER (PARTITION BY i ORDER BY n_name))::INT AS place FROM (SELECT unnest(['EUROPE', 'ASIA', 'AMERICA', 'AFRICA']) AS r, unnest([1, 2, 3, 4]) AS i) JOIN region ON r_name = r JOIN nation ON n_regionkey = r_regionkey")
def section_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within the groups of a fixed order."""
    sections = literal(spark, [(k, r, r) for k, r in enumerate(_REGIONS)], "ord int, key string, label string")
    books = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "section")
    return aggregates.section_rank(books, sections, "n_name").select("ord", "n_name", "place")


@query("""SELECT lang, [concat(len(l), ' long texts: [', array_to_string(list_sort(l)[1:5], ', '), ']')] AS issues FROM (SELECT lang, list(doc_id) FILTER (n_chars > 20000) AS l FROM documents GROUP BY lang) WHERE len(l) > 0
UNION ALL SELECT lang, []::VARCHAR[] FROM documents GROUP BY lang HAVING count(*) FILTER (n_chars > 20000) = 0""")
def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue texts with counts and the first five, of which no more are gathered."""
    docs = table(spark, sf_dir, "documents")
    long_ = aggregates.first_values(docs.where("n_chars > 20000"), ["lang"], "doc_id")
    rows = docs.select("lang").distinct().join(long_, "lang", "left")
    return rows.select("lang", aggregates.issues([(F.coalesce("n", F.lit(0)), "long texts", F.col("values"))]).alias("issues"))


# Filters and lookups


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), 'ar')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-blind substring search over two columns."""
    return filters.search(table(spark, sf_dir, "part"), "  AR ", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(c_name, '07')")
def id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id holds a part."""
    return filters.id_contains(table(spark, sf_dir, "customer"), "07", "c_name").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its key."""
    return filters.by_id(table(spark, sf_dir, "nation"), 7, "n_nationkey").select("n_nationkey", "n_name")


@query("SELECT o_orderkey, max(l_quantity) FILTER (l_linenumber = 2) AS second FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map by text keys, looked up by number; null where there is none."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    lines = own.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("string"), "l_quantity"))).alias("m"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", filters.chapter_of(F.col("m"), F.lit(2)).alias("second"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 1 AND 20 AND l_linenumber BETWEEN 2 AND 4")
def number_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on numbers and pages, pushed to the scan."""
    return filters.in_pages(table(spark, sf_dir, "lineitem"), F.lit(2), F.lit(4), "l_linenumber").where(F.col("l_quantity").between(1, 20)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS stop FROM lineitem JOIN (SELECT l_orderkey AS f, min(l_linenumber) AS m FROM lineitem GROUP BY 1) ON f = l_orderkey
WHERE l_linenumber > m AND l_quantity > 40 GROUP BY 1) ON k = l_orderkey WHERE stop IS NULL OR l_linenumber < stop""")
def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the first that fails, the first row aside."""
    return windows.take_while(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", F.col("l_quantity") <= 40).select("l_orderkey", "l_linenumber")


@query(r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\s*\d+\s*')), chr(10))) AS digest FROM documents")
def drop_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a number alone go."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(segment.drop_number_lines(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, source, length(text)::INT AS n FROM documents WHERE length(source) >= 5 AND source NOT IN ('src10', 'src12') AND length(text) >= 300 AND trim(text) <> ''")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of some length whose term isn't in the stop list."""
    notes = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("term"), F.col("text").alias("body"))
    return filters.substantial_notes(filters.non_blank(notes, "body"), ("src10", "src12"), 5, 300).select("doc_id", F.col("term").alias("source"), F.length("body").alias("n"))


# Joins


@query("""SELECT event_id, arg_max(o_orderkey, (epoch_us(o_orderdate)::HUGEINT * 100000000 - o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts GROUP BY event_id""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a user before each event, of ties the first by key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    got = joins.asof_backward(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), orders, "ts", "o_orderdate", "o_orderkey", ["user_id"])
    return got.select("event_id", "match.o_orderkey", "match.o_orderdate")


@query("""SELECT event_id, min(o_orderdate) AS next_page FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate > ts GROUP BY event_id""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next order of a user after each event."""
    starts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pdf"), F.col("o_orderdate").alias("page"))
    return joins.asof_forward(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("pdf"), F.col("ts").alias("page")), starts).select("event_id", "next_page")


@query(r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
SELECT token, TRUE AS known FROM d SEMI JOIN b USING (token) UNION ALL SELECT token, FALSE FROM d ANTI JOIN b USING (token)""")
def dictionary_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in and out of a dictionary."""
    tokens = lambda name: table(spark, sf_dir, name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    docs, words = tokens("documents"), tokens("benchmark").withColumnRenamed("token", "word")
    inside, outside = joins.in_dictionary(docs, words), joins.in_dictionary(docs, words, anti=True)
    return inside.withColumn("known", F.lit(True)).unionByName(outside.withColumn("known", F.lit(False)))


@query(f"""WITH n AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(0, greatest(1, len(w) - 4), 4), lambda i: array_to_string(w[i + 1:i + 8], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM n)),
d AS (SELECT doc_id, array_to_string({_WORDS.format(c='text')}, ' ') AS t FROM documents)
SELECT DISTINCT item_id, doc_id FROM win JOIN d ON contains(t, s)""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a word window of a benchmark item."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text"))
    return joins.contains_window(needles, table(spark, sf_dir, "documents").select("doc_id", "text"), "item_text", "text").select("item_id", "doc_id")


@query("""SELECT n_name, s_name FROM (SELECT n_nationkey, n_name, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation) a
LEFT JOIN (SELECT s_name, s_nationkey % 5 AS r, row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) AS i FROM supplier) b USING (r, i)""")
def zip_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th row of one list with the i-th of another."""
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r")
    suppliers = table(spark, sf_dir, "supplier").withColumn("r", F.col("s_nationkey") % 5)
    return joins.zip_rows(nations, suppliers, "n_nationkey", "s_suppkey", ["r"]).select("n_name", "s_name")


@query("SELECT r_name, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS side FROM region")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal map; a missing key is null."""
    return table(spark, sf_dir, "region").select("r_name", joins.lookup({"ASIA": "east", "EUROPE": "west"}, F.col("r_name")).alias("side"))


@query("SELECT o_orderkey AS id FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 5) USING (o_orderkey)")
def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows without a text: orders without a fifth line."""
    return corpus.missing_files(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("id")))


@query("SELECT p_partkey, CASE WHEN p_partkey <= 700 THEN 'one' ELSE 'two' END AS pdf, (CASE WHEN p_partkey <= 700 THEN p_partkey ELSE p_partkey - 700 END)::INT AS page, p_partkey::INT AS printed FROM part")
def piecewise_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range map and its inverse."""
    files = [("one", 0), ("two", 700)]
    rows = table(spark, sf_dir, "part").select("p_partkey", joins.piecewise_page(F.col("p_partkey"), files).alias("m"))
    return rows.select("p_partkey", "m.pdf", "m.page", joins.printed_page(F.col("m.pdf"), F.col("m.page"), files).alias("printed"))


@query("SELECT o_orderkey, o_custkey::INT AS printed, least(o_custkey + 2, 1000)::INT AS page FROM orders")
def anchor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of a file from the printed page, at most the last one."""
    from .operators.anchors import offset_pages

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("printed"))
    return offset_pages(rows, 2, F.lit(1000))


@query(r"SELECT DISTINCT doc_id AS page FROM documents WHERE regexp_matches(text, '\bthe +[a-z]+ of\b')")
def opener_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which a text opens."""
    from .operators.anchors import opener_pages as pages_of

    return pages_of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text"), r"\bthe +[a-z]+ of\b")


# Sequences


@query("""SELECT l_orderkey, arg_min(l_linenumber, p) AS got, (min(p) + 1)::INT AS expected FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS p FROM lineitem)
WHERE l_linenumber <> p + 1 GROUP BY 1""")
def gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number of a list that isn't the next one."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber")) - 1)
    return windows.first_gap(rows, ["l_orderkey"], "pos", "l_linenumber")


@query("SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE turn = 0 OR turn = n // 2 OR turn = n - 1")
def sample_first_mid_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, middle and last of each list (a sampling operator)."""
    return windows.sample_rows(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role")


@query("""SELECT c_custkey, unnest(CASE WHEN n >= 3 THEN [1, n // 2, n] ELSE range(1, n + 1)::INT[] END)::INT AS ch FROM (SELECT c_custkey, (c_custkey % 9)::INT AS n FROM customer) WHERE n > 0""")
def sample_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters that a check samples."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(windows.sample_chapters((F.col("c_custkey") % 9).cast("int"))).alias("ch"))


def _anchor_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    anchors = windows.first_pages(lines.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ch"), F.col("l_quantity").cast("int").alias("page")), ["id", "ch"])
    return anchors, lines.groupBy(F.col("l_orderkey").alias("id")).agg((F.max("l_linenumber") + 2).alias("chapter_count"))


_ANCHORS = """a AS (SELECT l_orderkey AS id, l_linenumber AS ch, min(l_quantity::INT) AS page FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL),
x AS (SELECT l_orderkey AS id, max(l_linenumber) + 2 AS n FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_ANCHORS}, w AS (SELECT id, unnest(range(1, n + 1))::INT AS ch FROM x), j AS (SELECT w.id, w.ch, page, CASE WHEN page IS NOT NULL THEN w.ch END AS c FROM w LEFT JOIN a ON a.id = w.id AND a.ch = w.ch),
k AS (SELECT *, last_value(c IGNORE NULLS) OVER l AS lc, last_value(page IGNORE NULLS) OVER l AS lp, first_value(c IGNORE NULLS) OVER r AS rc, first_value(page IGNORE NULLS) OVER r AS rp FROM j
WINDOW l AS (PARTITION BY id ORDER BY ch ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY id ORDER BY ch ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, ch, (CASE WHEN page IS NOT NULL THEN page WHEN lp IS NOT NULL AND rp IS NOT NULL THEN lp + round_even(((rp - lp) * (ch - lc))::DOUBLE / (rc - lc), 0)::INT ELSE coalesce(lp, rp) END)::INT AS page, page IS NOT NULL AS anchored FROM k""")
def interp_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of chapters, interpolated between fixed anchors."""
    return windows.interpolate(*_anchor_tables(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ANCHORS}, nx AS MATERIALIZED (SELECT x.id, g.ch::INT AS ch, x.n, own.page AS own, nxt.ch AS nc, nxt.page AS np FROM x, LATERAL (SELECT unnest(range(1, x.n + 1)) AS ch) g LEFT JOIN a own ON own.id = x.id AND own.ch = g.ch
ASOF LEFT JOIN a nxt ON nxt.id = x.id AND nxt.ch > g.ch),
f AS (SELECT id, ch, coalesce(own, np) AS page FROM nx WHERE ch = 1 UNION ALL
SELECT nx.id, nx.ch, CASE WHEN own IS NOT NULL THEN own WHEN f.page IS NOT NULL AND np IS NOT NULL THEN f.page + round_even((np - f.page)::DOUBLE / (nc - f.ch), 0)::INT ELSE coalesce(f.page, np) END FROM f JOIN nx ON nx.id = f.id AND nx.ch = f.ch + 1)
SELECT id, ch, page::INT AS page FROM f""")
def interp_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated with filled chapters as anchors."""
    return windows.interpolate_cumulative(*_anchor_tables(spark, sf_dir))


@query("""WITH a AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS ch, o_orderstatus AS pdf, (o_orderkey % 1000)::INT AS page FROM orders),
n AS (SELECT pdf, page, lead(page) OVER (PARTITION BY pdf ORDER BY page) AS np FROM (SELECT DISTINCT pdf, page FROM a)),
l AS (SELECT *, lead(pdf) OVER w AS lpdf, lead(page) OVER w AS lpage FROM a WINDOW w AS (PARTITION BY id ORDER BY ch))
SELECT id, ch, l.pdf, l.page AS first, (CASE WHEN lpdf = l.pdf THEN greatest(l.page, lpage) ELSE least(coalesce(np - 1, l.page + 6), l.page + 12) END)::INT AS last FROM l JOIN n ON n.pdf = l.pdf AND n.page = l.page""")
def chapter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of chapters."""
    anchors = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ch"), F.col("o_orderstatus").alias("pdf"), (F.col("o_orderkey") % 1000).cast("int").alias("page"))
    return windows.chapter_ranges(anchors, joins.next_start(anchors))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS prev_ch, CASE WHEN l_linenumber < 4 THEN l_linenumber + 1 END AS next_ch FROM lineitem")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters before and after."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(4).alias("chapter_count"))
    return windows.neighbours(rows, "l_linenumber").drop("chapter_count")


@query(f"""SELECT item_id, list_transform(range(0, greatest(1, len(w) - 4), 4), lambda i: array_to_string(w[i + 1:i + 8], ' ')) AS audit, list_transform(range(0, greatest(1, len(w) - 5), 4), lambda i: array_to_string(w[i + 1:i + 8], ' ')) AS checked
FROM (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark)""")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of words, both margins."""
    rows = table(spark, sf_dir, "benchmark").withColumn("w", tx.words(F.col("text")))
    return rows.select("item_id", windows.word_windows(F.col("w")).alias("audit"), windows.word_windows(F.col("w"), 5).alias("checked"))


_PLAIN = r"regexp_replace(text, '\d', '', 'g')"


@query(rf"""SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::INT AS n, 'x' || trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) AS t FROM conversations""")
def segment_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered texts joined and taken apart again."""
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    rows = rows.withColumn("t", F.concat(F.col("n").cast("string"), F.lit(" x"), F.trim(F.regexp_replace("text", r"\d", ""))))
    joined = aggregates.concat_ordered(rows, ["conv_id"], "n", "t", " ")
    return joined.select("conv_id", F.inline(segment.segments(F.col("t"), segment.SPACED)))


@query("""WITH RECURSIVE s AS MATERIALIZED (SELECT l_orderkey, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem),
f AS (SELECT l_orderkey, k, q BETWEEN 1 AND 6 AS hit, CASE WHEN q BETWEEN 1 AND 6 THEN q + 1 ELSE 1 END AS e, q FROM s WHERE k = 1 UNION ALL
SELECT s.l_orderkey, s.k, s.q BETWEEN greatest(f.e, 1) AND least(f.e + 5, 200), CASE WHEN s.q BETWEEN greatest(f.e, 1) AND least(f.e + 5, 200) THEN s.q + 1 ELSE f.e END, s.q FROM f JOIN s ON s.l_orderkey = f.l_orderkey AND s.k = f.k + 1)
SELECT l_orderkey, coalesce(list(q ORDER BY k) FILTER (hit), []) AS accepted FROM f GROUP BY 1""")
def marker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward-progress acceptance of a sequence of numbers."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))), lambda x: x.q).alias("q"))
    accepted = segment.accept(F.col("q"), F.transform("q", lambda _: F.lit("x")))
    return lists.select("l_orderkey", F.transform(accepted, lambda x: x.n).alias("accepted"))


_PLACED = """w AS (SELECT (l_orderkey % 4)::VARCHAR AS pdf, (l_orderkey // 64)::INT AS page, ((l_orderkey % 64) // 4 * 10 + l_linenumber)::INT AS pos, l_partkey::VARCHAR AS text, (l_suppkey % 100)::DOUBLE AS x0,
(l_suppkey % 100 + CASE WHEN l_linenumber = 3 THEN 40 ELSE 4 END)::DOUBLE AS x1, l_quantity AS top, l_quantity + 4 AS bottom, 6 + l_partkey % 5 // 2 * 2 AS size FROM lineitem)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of 16 orders as the words of a page, placed by their numbers."""
    at = F.col("l_suppkey") % 100
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 4).cast("string").alias("pdf"), F.floor(F.col("l_orderkey") / 64).cast("int").alias("page"), (F.floor(F.col("l_orderkey") % 64 / 4) * 10 + F.col("l_linenumber")).cast("int").alias("pos"),
        F.col("l_partkey").cast("string").alias("text"), at.cast("double").alias("x0"), (at + F.when(F.col("l_linenumber") == 3, 40).otherwise(4)).cast("double").alias("x1"), F.col("l_quantity").alias("top"),
        (F.col("l_quantity") + 4).alias("bottom"), (6 + F.floor(F.col("l_partkey") % 5 / 2) * 2).cast("double").alias("size"), F.lit(100.0).alias("page_width"), F.lit(60.0).alias("page_height"))


@query(f"""WITH RECURSIVE {_PLACED}, band AS (SELECT pdf, page, coalesce(max(bottom) FILTER (x0 < 45 AND x1 > 55 AND top < 9), 0.0) AS hy FROM w GROUP BY ALL),
r AS (SELECT w.*, top < hy - 0.5 AS head, x0 + (x1 - x0) / 2 >= 50 AS rgt FROM w JOIN band USING (pdf, page)),
sides AS (SELECT 'head' AS side, * FROM r WHERE head UNION ALL SELECT 'l', * FROM r WHERE NOT head AND NOT rgt UNION ALL SELECT 'r', * FROM r WHERE NOT head AND rgt UNION ALL SELECT 'body', * FROM r WHERE NOT head),
o AS MATERIALIZED (SELECT pdf, page, side, top::DOUBLE AS top, x0, text, row_number() OVER (PARTITION BY pdf, page, side ORDER BY top, pos, x0, text) AS i FROM sides),
f AS (SELECT pdf, page, side, 1::BIGINT AS i, [{{'total': top, 'words': [{{'x0': x0, 'k': 1::BIGINT, 't': text}}]}}] AS acc FROM o WHERE i = 1 UNION ALL
SELECT pdf, page, side, i, CASE WHEN p > 0 THEN list_transform(acc, lambda b, k: CASE WHEN k = p THEN {{'total': b.total + top, 'words': list_append(b.words, {{'x0': x0, 'k': i, 't': text}})}} ELSE b END)
ELSE list_append(acc, {{'total': top, 'words': [{{'x0': x0, 'k': i, 't': text}}]}}) END FROM (SELECT o.*, f.acc, coalesce(list_position(list_transform(f.acc, lambda b: abs(b.total / len(b.words) - o.top) <= 5), true), 0) AS p
FROM f JOIN o ON o.pdf = f.pdf AND o.page = f.page AND o.side = f.side AND o.i = f.i + 1)),
done AS (SELECT pdf, page, side, arg_max(acc, i) AS acc FROM f GROUP BY ALL),
lines AS (SELECT pdf, page, side, list_transform(list_sort(list_transform(acc, lambda b, k: {{'mean': b.total / len(b.words), 'k': k, 'words': b.words}})), lambda b: array_to_string(list_transform(list_sort(b.words), lambda x: x.t), ' ')) AS l FROM done),
n AS (SELECT pdf, page, count(*) FILTER (NOT head) AS body, count(*) FILTER (NOT head AND rgt) AS r, count(*) FILTER (NOT head AND NOT rgt) AS l, max(x1) FILTER (NOT head AND NOT rgt) AS le, min(x0) FILTER (NOT head AND rgt) AS rs FROM r GROUP BY ALL),
p AS (SELECT pdf, page, coalesce(any_value(l) FILTER (side = 'head'), []) AS h, coalesce(any_value(l) FILTER (side = 'l'), []) AS l, coalesce(any_value(l) FILTER (side = 'r'), []) AS r, coalesce(any_value(l) FILTER (side = 'body'), []) AS b FROM lines GROUP BY ALL)
SELECT pdf, page, array_to_string(CASE WHEN n.body > 0 AND NOT (n.r = 0 OR n.l = 0 OR n.rs >= n.le - 5) AND (n.r < 0.2 * n.body OR n.l < 0.2 * n.body) THEN list_concat(p.h, p.b) ELSE list_concat(list_concat(p.h, p.l), p.r) END, chr(10)) AS text FROM p JOIN n USING (pdf, page)""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, columns and lines of placed words."""
    return layout.page_text(_placed(spark, sf_dir))


@query(f"""WITH {_PLACED}, c AS (SELECT pdf, page, round_even(size, 0) AS s, count(*) AS c, min(pos) AS p FROM w GROUP BY ALL), b AS (SELECT pdf, page, arg_max(s, c * 1000 - p) AS body FROM c GROUP BY ALL),
e AS (SELECT pdf, page, max(bottom) AS e FROM w JOIN b USING (pdf, page) WHERE abs(size - body) <= 0.7 GROUP BY ALL)
SELECT pdf, page, pos, text FROM w JOIN b USING (pdf, page) LEFT JOIN e USING (pdf, page) WHERE NOT coalesce(size < body - 0.7 AND top >= e - 1, FALSE)""")
def footnote_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters but those smaller than the body of their page and below it."""
    return layout.drop_footnotes(_placed(spark, sf_dir)).select("pdf", "page", "pos", "text")


# Functions


@query(f"SELECT doc_id, md5(array_to_string({_WORDS.format(c='text')}, ' ')) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text normalized for matching."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_match(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(upper(translate(strip_accents(replace(text, 'ß', 'ss')), '‘’“”—–', '''''\"\"--'))) AS heading, md5(upper(translate(replace(text, 'ß', 'ss'), '''’ʼ‘`', ''))) AS bare FROM documents")
def normalize_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text normalized for headings, and without apostrophes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalize_heading(F.col("text")).cast("binary")).alias("heading"), F.md5(tx.bare_upper(F.col("text")).cast("binary")).alias("bare"))


_ROMANS = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII XXIII XXIV XXV".split()


@query(f"SELECT n_nationkey, {_ROMANS}[n_nationkey + 1] AS roman, n_nationkey + 1 AS value FROM nation")
def roman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals there and back."""
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.to_roman(F.col("n_nationkey") + 1).alias("roman"), tx.from_roman(tx.to_roman(F.col("n_nationkey") + 1)).alias("value"))


@query(r"""SELECT n_nationkey, CASE WHEN n_name = upper(n_name) THEN 'WORD' ELSE 'word' END AS a, 'Word' AS b, upper(n_name[1]) || lower(n_name[2:]) AS c FROM nation""")
def case_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case of one word given to another."""
    titled = F.concat(F.substring("n_name", 1, 1), F.lower(F.substring("n_name", 2, 100)))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.case_like(F.lit("word"), F.col("n_name")).alias("a"), tx.initial_like(F.lit("word"), F.col("n_name")).alias("b"), tx.case_like(F.lower("n_name"), titled).alias("c"))


@query("""SELECT page_id, md5(regexp_replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?s)&lt;span class="(hwhy|dn)"&gt;(.*?)&lt;/span&gt;', '<span class="\\1">\\2</span>', 'g')) AS digest FROM pages""")
def escape_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped markup but for two spans."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.escape_markup(F.col("html")).cast("binary")).alias("digest"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<[^>]+>|[^<]+|<'))::INT AS parts, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages""")
def tag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags apart from text."""
    return table(spark, sf_dir, "pages").select("page_id", F.size(tx.tags_and_text(F.col("html"))).alias("parts"), F.md5(tx.strip_tags(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT conv_id, count(*) = 1 AND max(length(text)) > 600 AS prose FROM conversations GROUP BY 1")
def prose_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that are one long verse."""
    verses = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("n"), F.col("text").alias("t")))).alias("v"))
    return verses.select("conv_id", tx.is_prose(F.col("v")).alias("prose"))


@query("""SELECT c_custkey, c_name || CASE WHEN c_nationkey > 1 THEN ' ' || c_nationkey ELSE '' END || CASE WHEN c_acctbal > 0 THEN ':' || c_custkey % 9 ELSE '' END AS label,
'chapter.html?id=' || replace(replace(replace(c_name || ' é', '#', '%23'), ' ', '%20'), 'é', '%C3%A9') || '&ch=' || c_nationkey || CASE WHEN c_acctbal > 0 THEN '&v=' || c_custkey % 9 ELSE '' END AS url, c_nationkey AS route_ch FROM customer""")
def labels_and_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference labels, URLs and routes."""
    verse = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") % 9)
    route = tx.parse_route(F.concat(F.lit("#/book/"), tx.encode_component(F.col("c_name")), F.lit("/"), F.col("c_nationkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.reference_label(F.col("c_name"), F.col("c_nationkey"), F.col("c_nationkey"), verse).alias("label"),
                                                   tx.chapter_url(F.concat("c_name", F.lit(" é")), F.col("c_nationkey"), verse).alias("url"), route.chapter.alias("route_ch"))


@query(r"""SELECT event_id, coalesce(nullif(TRY_CAST(nullif(regexp_extract(v, '^\s*([+-]?[0-9]+)', 1), '') AS INT), 0), 1) AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id || 'x' WHEN 1 THEN ' -' || event_id WHEN 2 THEN event_type ELSE '0' END AS v FROM events)""")
def parse_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer a text starts with, or a default."""
    kind, number = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(kind == 0, F.concat(number, F.lit("x"))).when(kind == 1, F.concat(F.lit(" -"), number)).when(kind == 2, F.col("event_type")).otherwise("0")
    return table(spark, sf_dir, "events").select("event_id", tx.int_or(text, 1).alias("n"))


@query("""SELECT page_id, md5(replace(html, '</', '<\\/')) AS digest FROM pages""")
def script_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that can stand in a script."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.script_safe(F.col("html")).cast("binary")).alias("digest"))


# Rules and repair

_RULES = {"the": "zeh", "and": "we", "of": "shel", "with": "im", "que": "ki", "die": "ha", "les": "eth"}


def _like(target: str) -> str:
    return f"CASE WHEN w = upper(w) AND w <> lower(w) THEN upper({target}) WHEN w[1] = upper(w[1]) AND w[1] <> lower(w[1]) AND w[2:] = lower(w[2:]) THEN upper({target}[1]) || {target}[2:] ELSE {target} END"


@query(rf"""WITH r AS (SELECT MAP {{{', '.join(f"'{k}': '{v}'" for k, v in _RULES.items())}}} AS m),
t AS (SELECT doc_id, i, x, CASE WHEN m[lower(x)] IS NOT NULL THEN x WHEN lower(x)[-1] = 's' AND m[lower(x)[:-2]] IS NOT NULL THEN x[:-2] END AS w, CASE WHEN m[lower(x)] IS NOT NULL THEN '' ELSE x[-1] END AS tail, m
FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS l FROM documents)), r)
SELECT d.doc_id, md5(coalesce(s, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN x ELSE ({_like('m[lower(w)]')}) || tail END, '' ORDER BY i) AS s FROM t GROUP BY 1) USING (doc_id)""")
def transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word rules over whole texts in one pass."""
    out = translit.apply_rules(F.col("text"), divine={}, plain=_RULES, prefixes=())
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("digest"))


_SPAN = '<span class="dn">{}</span>'
_RULE_CASES = [
    ("possessive", "God's Gods", f"{_SPAN.format('Aluahim')}'s {_SPAN.format('Aluahim')}s"), ("case", "GOD god", f"{_SPAN.format('ALUAHIM')} {_SPAN.format('Aluahim')}"),
    ("longest", "the Lord God", f"{_SPAN.format('Yahuah')} {_SPAN.format('Aluahim')}"), ("prefix", "Elect Elam elbow", "Elect Alam Albow"),
    ("yi_ye", "Yerushalayim YERUSHALAYIM Year", "Yahrushalayim YAHRUSHALAYIM Year"), ("el", "Uriel URIEL Shemu’ĕl wheel", "Urial URIAL Shemu’al wheel"), ("parts", "Yael’el’el’EL'el’el", "Yaal’al’al’AL'al’al"),
    ("name", "HWHY", f'({_SPAN.format("YAHUAH")}) <span class="hwhy">HWHY</span>'), ("stranded", f"Yisra’{_SPAN.format('Al')}ites", "Yasharalites"), ("null", None, None),
]


@query(_values([(k, o) for k, _, o in _RULE_CASES], "kind, output"))
def rule_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default tables and all passes, on literal cases."""
    return literal(spark, [(k, i) for k, i, _ in _RULE_CASES], "kind string, t string").select("kind", translit.transliterate(F.col("t")).alias("output"))


_REPAIR_CASES = [(1, "the moun tains", "the mountains"), (2, "Aram is", "Aram is"), (3, "Twentyone men", "Twenty-one men"), (4, "moun- tains <b>moun tains</b> x", "mountains <b>mountains</b> x"),
                 (5, "ci ties mak ing lClem 3:4", "cities making 1Clem 3:4"), (6, None, None), (7, "", ""), (8, "x ka lo mi nu pe ro su ti vu za y", "x kalominuperosutivuza y")]


@query(_values([(k, o) for k, _, o in _REPAIR_CASES], "k, output"))
def repair_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs, on literal cases."""
    words = literal(spark, [(w,) for w in ["the", "mountains", "aramis", "city", "make", "aram", *("kalominuperosutivuza"[: 2 * k] for k in range(2, 11))]], "word string")
    return repair.fix_text(literal(spark, [(k, i) for k, i, _ in _REPAIR_CASES], "k int, t string"), "k", "t", words).select("k", F.col("t").alias("output"))


@query()
def repair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs over whole documents, by the words of the benchmark and the corpus' own frequencies, with the counts of each pass."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    dictionary = table(spark, sf_dir, "benchmark").select(F.explode(tx.ascii_tokens(F.col("text"))).alias("word")).distinct()
    fixed = repair.fix_text(docs, "doc_id", "t", dictionary)
    return fixed.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), "n_citation", "n_hyphen", "n_soft", "n_unglued")


@query(r"""WITH t AS (SELECT lower(x) AS token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM documents) GROUP BY 1), d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark)
SELECT token AS word, token IN (SELECT w FROM d) AS direct, freq FROM t""")
def word_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary and corpus facts of every word."""
    frequency = aggregates.token_frequency(table(spark, sf_dir, "documents"))
    dictionary = table(spark, sf_dir, "benchmark").select(F.explode(tx.ascii_tokens(F.col("text"))).alias("word"))
    return repair.word_facts(frequency.select(F.col("token").alias("word")), dictionary, frequency).select("word", "direct", "freq")


_LAYOUT_CASES = [
    ("primary", 3, "foo 3 In the beginning 2 the 4 Next One", "1 In the beginning|2 the"), ("enoch", 2, "x\nChapter\t2\nThe Title\n1 one two 2 three\nChapter 3\n1 no", "1 one two|2 three"),
    ("jasher", 1, "I\n1 And a\n2 And b\n44\nII\n1 c", "1 And a|2 And b"), ("adam-eve-1", 4, "Chapter IV\nThe grief. Cain goes.\nFirst para\n2 And so\nChapter V\n1 x", "1 First para|2 And so"),
    ("adam-eve-2", 4, "CHAP. IV.\n1 And\nCHAP. V.\n1 x", "1 And"), ("clement", 2, "zz 1Clem 2:1 aa 1Clem 2:2 bb 1Clem 3:1 c", "1 aa|2 bb"), ("colon", 2, "zz 2:1 aa 2:1 bb 3:1 c", "1 aa|1 bb"),
    ("apocrypha", 2, "Chapter 2 [1-3] aa [4] bb Chapter 3", "1 aa|4 bb"), ("apocrypha", 5, "Chapter 5 1 aa 9 lost 2 bb Chapter 6", "1 aa|2 bb"), ("enoch", 9, "no marks at all", "1 no marks at all"), ("unknown", 1, "1 x", None),
]


@query(_values([(g, c, o) for g, c, _, o in _LAYOUT_CASES], "grammar, ch, verses"))
def layout_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layout of single chapters, on literal texts; testament_cases has T5 and T11."""
    from .plans.etl import chapter_verses

    rows = literal(spark, [(g, c, t) for g, c, t, _ in _LAYOUT_CASES], "grammar string, ch int, t string")
    verses = chapter_verses(F.col("grammar"), F.col("t"), F.col("ch"))
    return rows.select("grammar", "ch", F.array_join(F.transform(verses, lambda v: F.concat_ws(" ", v.n, v.t)), "|").alias("verses"))


_TESTAMENT_PAGES = [
    "THE TESTAMENTS\n1 1 The copy of the words of Reuben, which he spake 2 unto his sons. 2 1, 2 And now hear\nmePage | 1", "3 my children. 5 l But flee 2 the end\nThe copy of the words of Judah, what things he spake. 2 1 And the Lord 2 gave me grace 3 said 9 7 the law",
    "[The Apocrypha and Pseudepigrapha x] www.Scriptural-Truth.com 4 1 And I ran 20 1 Then no\nThe copy of the words of Dan, old. The book of the words of Dan, new.",
]
_TESTAMENT_CASES = [
    ("testament-reuben", 1, 7, "1 The copy of the words of Reuben, which he spake|2 unto his sons."), ("testament-reuben", 2, 7, "1 And now hear me|3 my children."), ("testament-reuben", 5, 7, "1 l But flee|2 the end"),
    ("testament-yahudah", 1, 40, "1 The copy of the words of Judah, what things he spake."), ("testament-yahudah", 2, 40, "1 And the Lord|2 gave me grace|3 said|9 the law"), ("testament-yahudah", 4, 40, "1 And I ran"),
    ("testament-dan", 1, 1, "1 The book of the words of Dan, new."),
]


@query(_values(_TESTAMENT_CASES, "id, ch, page, verses"))
def testament_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5, and its part of T11: every chapter of the books of a file of testaments, with the book's page; on literal pages."""
    from .plans import etl

    pages = literal(spark, [(etl.TESTAMENT_FILE, k, t) for k, t in enumerate(_TESTAMENT_PAGES, 1)], "pdf string, page int, text string")
    anchors = literal(spark, [(b, 1, etl.TESTAMENT_FILE, p) for b, p in (("testament-reuben", 7), ("testament-yahudah", 40), ("testament-gad", 90))], "id string, ch int, pdf string, page int")
    grammars = literal(spark, [(b, "testament", "", "") for b in ("testament-reuben", "testament-yahudah", "testament-dan", "testament-gad")], "id string, grammar string, hebrew string, english string")
    rows = etl.testaments(pages, anchors, grammars)
    return rows.select("id", "ch", "page", F.array_join(F.transform("verses", lambda v: F.concat_ws(" ", v.n, v.t)), "|").alias("verses"))


@query(_values([("Elohim", "The ending is really YM, and so on."), ("Sabbath", "Shin-beth-tau means cease or rest.")], "term, body"))
def note_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes apart, short ones and those of stop terms left out."""
    text = "Elohim: The ending is  really YM, and so on.\nSabbath: Shin-beth-tau means cease or rest.\nNow: this is not a note whatever its length is.\nShort: too short"
    return filters.substantial_notes(layout.page_notes(literal(spark, [("f", 1, text)], "pdf string, page int, text string"))).select("term", "body")


@query(_values([(1, "ab c")], "page, text"))
def footnote_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small characters below the body, as lines of text."""
    body = [("f", 1, i, c, float(i), i + 1.0, 10.0, 20.0, 10.0, 1.0) for i, c in enumerate("body")]
    foot = [("f", 1, 9 + i, c, x, x + 1.0, 30.0, 38.0, 8.0, 1.0) for i, (c, x) in enumerate([("a", 0.0), ("b", 1.0), ("c", 3.0)])]
    chars = literal(spark, body + foot, "pdf string, page int, pos int, text string, x0 double, x1 double, top double, bottom double, size double, width double")
    return layout.footnote_text(layout.footnote_chars(chars)).select("page", "text")


@query(_values([("j", 1, 7), ("j", 2, 7), ("j", 3, 9), ("j", 4, 9)], "id, ch, page"))
def anchor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman headings after the contents that a first verse follows, completed."""
    from .operators.anchors import roman_anchors

    pages = literal(spark, [("j", 1, "I\n1 no contents"), ("j", 7, "x\nII\n1 And so"), ("j", 8, "IX\nnot a verse"), ("j", 9, "\nIII\n1 “Go")], "id string, page int, text string")
    return roman_anchors(pages, literal(spark, [("j", 4)], "id string, chapter_count int")).select("id", "ch", "page")


@query("""WITH v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p FROM conversations), g AS (SELECT conv_id FROM v WHERE turn + 1 <> p + 1 GROUP BY 1)
SELECT conv_id::VARCHAR AS id, count(*)::BIGINT AS extracted_verses, round_even(count(*) / 6.0 * 100, 1)::DOUBLE AS recovery, CASE WHEN count(*) / 6.0 < 0.7 OR any_value(g.conv_id) IS NOT NULL THEN 'ISSUES' ELSE 'OK' END AS status
FROM v LEFT JOIN g USING (conv_id) GROUP BY conv_id""")
def book_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a book of six expected verses, checked against pages that are its own texts."""
    from .operators.audit import check_books

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.lit(1).alias("ch"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("pos"),
                                                        (F.col("turn") + 1).cast("int").alias("n"), F.col("text").alias("t"))
    rows = written(rows, "verses")  # read many times below
    ids = rows.select("id").distinct()
    meta = ids.select("id", F.col("id").alias("hebrew"), F.col("id").alias("english"), F.lit("s").alias("section"), F.lit(1).alias("chapter_count"))
    chapters = ids.select("id", F.lit(1).alias("ch"), F.col("id").alias("pdf"), F.lit(1).alias("page"))
    pages = aggregates.concat_ordered(rows, ["id"], "pos", "t").select(F.col("id").alias("pdf"), F.lit(1).alias("page"), F.col("t").alias("text"))
    checked = check_books(meta, rows, chapters, ids.select("id", F.lit(6).alias("expected")), pages)
    return checked.select("id", "extracted_verses", "recovery", "status")


# State, sources and sets


def _mark_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "toggle").when(F.col("event_type") == "view", "read")
    return table(spark, sf_dir, "events").withColumn("action", action).where("action IS NOT NULL").select(
        "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), "action", F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("book"), (F.col("event_id") % 2).cast("int").alias("chapter"),
        F.when(F.col("event_id") % 5 == 0, F.lit(1)).alias("verse"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_type AS a, 'b' || event_id % 3 || ':' || event_id % 2 || ':' || CASE WHEN event_id % 5 = 0 THEN '1' ELSE '-' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events WHERE event_type IN ('purchase', 'error', 'click', 'view')),
f AS (SELECT user_id, 0::BIGINT AS i, []::VARCHAR[] AS s FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN a = 'purchase' OR a = 'click' AND NOT list_contains(s, k) THEN list_concat([k], list_filter(s, lambda x: x <> k))[1:4] WHEN a IN ('error', 'click') THEN list_filter(s, lambda x: x <> k) ELSE s END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, array_to_string(arg_max(s, i), ',') AS marks FROM f GROUP BY 1""")
def marks_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks after all events, with a cap of 4."""
    state = marks.fold_marks(_mark_events(spark, sf_dir), cap=4)
    shown = F.transform("marks", lambda m: F.concat_ws(":", m["book"], m["chapter"].cast("string"), F.coalesce(m["verse"].cast("string"), F.lit("-"))))
    return state.select("user_id", F.array_join(shown, ",").alias("marks"))


@query("SELECT user_id, 'b' || arg_max(event_id, epoch_ms(ts)::HUGEINT * 100000000 + event_id) % 3 AS book, (arg_max(event_id, epoch_ms(ts)::HUGEINT * 100000000 + event_id) % 2)::INT AS chapter FROM events WHERE event_type = 'view' GROUP BY 1")
def last_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: the last place read."""
    return marks.last_read(_mark_events(spark, sf_dir)).select("user_id", "last.book", "last.chapter")


_FOLDED = """e AS MATERIALIZED (SELECT user_id, event_type AS a, 'b' || event_id % 3 AS b, (event_id % 2)::INT AS c, CASE WHEN event_id % 5 = 0 THEN 1 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events),
f AS (SELECT user_id, 0::BIGINT AS i, []::STRUCT(b VARCHAR, c INT, v INT)[] AS s, NULL::VARCHAR AS r FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN a = 'signup' THEN [] WHEN a = 'purchase' OR a = 'click' AND NOT list_contains(s, {'b': b, 'c': c, 'v': v}) THEN list_concat([{'b': b, 'c': c, 'v': v}], list_filter(s, lambda x: x IS DISTINCT FROM {'b': b, 'c': c, 'v': v}))[1:6]
WHEN a IN ('error', 'click') THEN list_filter(s, lambda x: x IS DISTINCT FROM {'b': b, 'c': c, 'v': v}) ELSE s END, CASE WHEN a = 'signup' THEN NULL WHEN a = 'view' THEN b || ':' || c ELSE r END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1),
st AS (SELECT user_id, arg_max(s, i) AS s, arg_max(coalesce(r, ''), i) AS r FROM f GROUP BY 1)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of all events, of which sign-ups clear everything."""
    cleared = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), F.lit("clear").alias("action"), F.lit("b").alias("book"), F.lit(0).alias("chapter"), F.lit(None).cast("int").alias("verse"))
    return marks.fold_marks(_mark_events(spark, sf_dir).unionByName(cleared), cap=6)


@query(f"WITH RECURSIVE {_FOLDED} SELECT user_id, coalesce(array_to_string(list_transform(s, lambda x: x.b || ':' || x.c || ':' || coalesce(x.v::VARCHAR, '-')), ','), '') AS marks, r AS last_read FROM st")
def marks_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M4: a state that clear events empty, and the place last read since."""
    shown = F.transform("marks", lambda m: F.concat_ws(":", m["book"], m["chapter"].cast("string"), F.coalesce(m["verse"].cast("string"), F.lit("-"))))
    return _state(spark, sf_dir).select("user_id", F.array_join(shown, ",").alias("marks"), F.coalesce(F.concat_ws(":", "last_read.book", "last_read.chapter"), F.lit("")).alias("last_read"))


@query(f"WITH RECURSIVE {_FOLDED} SELECT user_id, list_sort(list_transform(list_filter(s, lambda x: x.b = 'b1' AND x.c = 0 AND x.v IS NOT NULL), lambda x: x.v)) AS verses FROM st")
def verses_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the verses marked in a chapter."""
    return marks.marked_verses(_state(spark, sf_dir), "b1", 0)


@query(f"WITH RECURSIVE {_FOLDED} SELECT user_id, len(s)::INT AS n_marks, len(s) > 0 OR user_id % 7 = 0 AS had FROM st")
def marks_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state written as JSON and read over a state of other marks, which it replaces; JSON that can't be read changes nothing."""
    state = _state(spark, sf_dir)
    files = marks.export_marks(state).withColumn("json", F.when(F.col("user_id") % 7 == 0, F.lit('{"bookmarks": [')).otherwise(F.col("json")))
    back = marks.import_marks(state.select("user_id", F.lit(None).cast("struct<book:string,chapter:int,ts:bigint>").alias("last_read"), F.when(F.col("user_id") % 7 == 0, F.col("marks")).otherwise(F.array(F.struct(
        F.lit("old").alias("book"), F.lit(1).alias("chapter"), F.lit(1).alias("verse"), F.lit(0).cast("bigint").alias("ts")))).alias("marks")), files)
    return back.select("user_id", F.size("marks").alias("n_marks"), ((F.size("marks") > 0) | (F.col("user_id") % 7 == 0)).alias("had"))


@query(r"""SELECT user_id AS key, CASE WHEN last % 3 = 0 THEN NULL ELSE (props ->> 'k')::INT END AS k FROM (SELECT user_id, arg_max(props, event_id) AS props, max(event_id) AS last FROM events WHERE event_id % 5 <> 0 GROUP BY 1)""")
def kept_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values kept by key, the last one written counts; one that can't be read is null."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_id") % 5 != 0, broken).alias("value"), F.col("event_id").alias("seq"))
    store = marks.keep_value(changes.select("key", "value").limit(0), changes)
    return store.select("key", marks.kept_value(F.col("value"), "k int").k.alias("k"))


@query("SELECT (conv_id % 20)::VARCHAR AS id, string_agg(DISTINCT (conv_id // 20 + 1)::VARCHAR, ',' ORDER BY (conv_id // 20 + 1)::VARCHAR) AS as_text, array_to_string(list_sort(list(DISTINCT conv_id // 20 + 1)), ',') AS chapters FROM conversations GROUP BY 1")
def chapter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters of a nested book in order of their numbers, 10 after 9."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("string").alias("id"), (F.floor(F.col("conv_id") / 20) + 1).cast("int").alias("ch"), F.col("turn").cast("int").alias("pos"), F.col("turn").cast("int").alias("n"),
                                                        F.col("text").alias("t"), F.lit(1).alias("page"), F.lit("f").alias("pdf"))
    meta = rows.select("id").distinct().select("id", F.col("id").alias("hebrew"), F.col("id").alias("english"), F.lit("s").alias("section"), F.lit(1).alias("chapter_count"))
    keys = F.map_keys("chapters")
    return corpus.nest(rows, meta).select("id", F.array_join(F.array_sort(keys), ",").alias("as_text"), F.array_join(keys, ",").alias("chapters"))


@query("SELECT conv_id::VARCHAR AS id, 1 AS ch, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS pos, turn::INT AS n, text AS t FROM conversations")
def nest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verses nested into books, and flat again."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.lit(1).alias("ch"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("pos"), F.col("turn").cast("int").alias("n"), F.col("text").alias("t"), F.lit(1).alias("page"), F.lit("f").alias("pdf"))
    meta = rows.select("id").distinct().select("id", F.col("id").alias("hebrew"), F.col("id").alias("english"), F.lit("s").alias("section"), F.lit(1).alias("chapter_count"))
    return corpus.verses(corpus.nest(rows, meta)).select("id", "ch", "pos", "n", "t")


@query("SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> upper(c_mktsegment) UNION ALL SELECT c_custkey, c_mktsegment || '!' FROM customer WHERE c_acctbal > 9000")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows whose value changed."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, F.upper("c_mktsegment")).when(F.col("c_acctbal") > 9000, F.concat("c_mktsegment", F.lit("!"))).otherwise(F.col("c_mktsegment")))
    return corpus.changed(old, new, ["c_custkey"], "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists one after the other, repeats included."""
    return aggregates.union_all([table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))])


@query("SELECT lower(n_name) AS word FROM nation UNION SELECT lower(r_name) FROM region")
def dictionary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary and more words, without repeats."""
    words = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("word"))
    return aggregates.extend_dictionary(words("nation", "n_name"), words("region", "r_name"))


@query("SELECT s_suppkey, rpad(s_name, greatest(length(s_name), 30)::INT, ' ') || ' ' || lpad(s_nationkey::VARCHAR, 4, ' ') AS line FROM supplier")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a fixed-width report."""
    from .sources.reports import fixed_width

    return table(spark, sf_dir, "supplier").select("s_suppkey", fixed_width([("s_name", 30, False), ("s_nationkey", 4, True)]).alias("line"))


@query("SELECT src, dst FROM (SELECT n_name AS src, n_nationkey::VARCHAR AS dst, row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey) AS k FROM nation) WHERE k <= 10")
def longest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by falling length, ties in their order (a top-k report)."""
    return table(spark, sf_dir, "nation").orderBy(F.length("n_name").desc(), "n_nationkey").limit(10).select(F.col("n_name").alias("src"), F.col("n_nationkey").cast("string").alias("dst"))
