"""Catalogues of keys with several forms: keyed selection, priority merges, look-ups, layered overrides, set sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.plans.registry import query
from specula.sources.tables import CAT, RATE, catalogue, ratings, table


@query("SELECT page_id, upper(regexp_replace(url, '\\.[^.]+$', '')) AS stem, lower(trim(replace(url, '\\', '/'))) AS path FROM pages")
def stem_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a file name without its extension, and its path for comparing."""
    return table(spark, sf_dir, "pages").select("page_id", F.upper(F.regexp_replace("url", r"\.[^.]+$", "")).alias("stem"), F.lower(F.trim(F.replace("url", F.lit("\\"), F.lit("/")))).alias("path"))


@query(f"WITH {CAT} SELECT rel, min(seq) AS seq, arg_min(bucket, seq) AS bucket FROM cat GROUP BY rel")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).groupBy("rel").agg(F.min("seq").alias("seq"), F.min_by("bucket", "seq").alias("bucket"))


@query(f"WITH {CAT}, {RATE}, k AS (SELECT rel, count(*) AS forms FROM cat GROUP BY rel) SELECT k.rel, forms, coalesce(star, 0) AS star, CASE WHEN coalesce(star, 0) < 1 THEN 'unrated' ELSE 'rated' END AS state FROM k LEFT JOIN rate USING (rel)")
def rating_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their rating; a missing one is 0."""
    forms = catalogue(spark, sf_dir).groupBy("rel").agg(F.count(F.lit(1)).alias("forms"))
    star = F.coalesce("star", F.lit(0))
    return forms.join(ratings(spark, sf_dir), "rel", "left").select("rel", "forms", star.alias("star"), F.when(star < 1, "unrated").otherwise("rated").alias("state"))


@query(f"WITH {CAT}, {RATE} SELECT DISTINCT cat.rel FROM cat JOIN rate USING (rel) WHERE star >= 4")
def min_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).select("rel").join(ratings(spark, sf_dir).where("star >= 4"), "rel", "left_semi").distinct()


@query("WITH e AS (SELECT event_id, value, [10.0, 50.0, 100.0, 250.0] AS edges FROM events) SELECT event_id, CAST(len(list_filter(edges, lambda x: value >= x)) AS INT) AS bin FROM e")
def bin_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ascending thresholds; a value on an edge belongs above it."""
    edges = F.array(*map(F.lit, (10.0, 50.0, 100.0, 250.0)))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.filter(edges, lambda e: F.col("value") >= e)).alias("bin"))


@query("SELECT event_id, CAST(least(greatest(CAST(floor(value) AS BIGINT), 16), 200) AS BIGINT) AS side, value < 16 OR floor(value) > 200 AS clamped FROM events")
def clamp_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.floor("value").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(side, F.lit(16)), F.lit(200)).alias("side"), ((F.col("value") < 16) | (side > 200)).alias("clamped"))


@query("SELECT p_partkey, concat_ws('_', list_extract(string_split(lower(trim(p_name)), ' '), 1) || coalesce(list_extract(string_split(lower(trim(p_name)), ' '), 2), ''), array_to_string(list_slice(string_split(lower(trim(p_name)), ' '), 3, 99), '_')) AS stock, 'v' || regexp_replace(regexp_replace(p_brand, '[^0-9.]', '', 'g'), '\\.', '', 'g') AS version FROM part")
def normalize_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in lower case with the first two words fused; digits of a version."""
    w = F.split(F.lower(F.trim("p_name")), " ")
    fused = F.concat(F.get(w, F.lit(0)), F.coalesce(F.get(w, F.lit(1)), F.lit("")))
    digits = F.regexp_replace(F.regexp_replace("p_brand", "[^0-9.]", ""), r"\.", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("_", fused, F.array_join(F.slice(w, 3, 97), "_")).alias("stock"), F.concat(F.lit("v"), digits).alias("version"))


@query("SELECT o_orderkey, coalesce('raw/' || c.c_name, 'own/' || CAST(o_custkey AS VARCHAR)) AS load_path FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey = o.o_custkey")
def load_path_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each form's file: that of its key where there is one, else its own."""
    raw = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(raw, "o_custkey", "left").select("o_orderkey", F.coalesce(F.concat(F.lit("raw/"), "c_name"), F.concat(F.lit("own/"), F.col("o_custkey").cast("string"))).alias("load_path"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@query(f"WITH {CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY priority DESC, seq) AS k FROM cat) SELECT rel, bucket, seq FROM r WHERE k = 1")
def bucket_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each key the form in the bucket of highest priority, the first of equals: one aggregate, no sort."""
    best = F.max_by(F.struct("bucket", "seq"), F.struct("priority", (-F.col("seq")).alias("s"))).alias("x")
    return catalogue(spark, sf_dir).groupBy("rel").agg(best).select("rel", "x.bucket", "x.seq")


@query("SELECT l_orderkey, arg_min(l_shipdate, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END * 1000000000000000 + epoch_us(l_shipdate) / 1000000) AS shipped FROM lineitem GROUP BY l_orderkey")
def pair_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the forms of a key the preferred kind, the earliest of it."""
    kind = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_shipdate", F.struct(kind, "l_shipdate")).alias("shipped"))


@query(
    "WITH f AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT count(*) AS pairs, round(log2(quantile_cont(f.v / o.v, 0.5)), 6) AS ev FROM f JOIN o USING (k)"
)
def calib_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median ratio of two renditions of each key, in stops."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O"]).agg(F.avg("o_totalprice")).where("F is not null and O is not null")
    return o.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.log2(F.expr("percentile(F / O, 0.5)")), 6).alias("ev"))


_LAYERS = "layers AS (SELECT * FROM (VALUES ('all', '*', 'gain', 1.0, 0), ('all', '*', 'hue', 10.0, 0), ('segment', 'BUILDING', 'gain', 1.2, 1), ('segment', 'MACHINERY', 'hue', 20.0, 1), ('nation', '3', 'gain', 1.5, 2), ('nation', '7', 'hue', 30.0, 2)) t(scope, key, field, value, rank))"


@query(
    f"""WITH {_LAYERS}, m AS (SELECT c_custkey, field, value, rank FROM customer JOIN layers ON (scope = 'all') OR (scope = 'segment' AND key = c_mktsegment) OR (scope = 'nation' AND key = CAST(c_nationkey AS VARCHAR)))
SELECT c_custkey, arg_max(value, rank) FILTER (WHERE field = 'gain') AS gain, arg_max(value, rank) FILTER (WHERE field = 'hue') AS hue, CAST(count(*) FILTER (WHERE rank > 0) AS BIGINT) AS hits FROM m GROUP BY c_custkey"""
)
def layered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters by layers, later ones winning: small look-ups for each scope, no aggregate of the large side."""
    segment = F.create_map(*map(F.lit, ("BUILDING", 1.2)))
    hue_segment = F.create_map(*map(F.lit, ("MACHINERY", 20.0)))
    nation, hue_nation = F.create_map(F.lit(3), F.lit(1.5)), F.create_map(F.lit(7), F.lit(30.0))
    seg, nat = F.col("c_mktsegment"), F.col("c_nationkey")
    hits = [F.try_element_at(m, k) for m, k in ((segment, seg), (hue_segment, seg), (nation, nat), (hue_nation, nat))]
    gain, hue = F.coalesce(hits[2], hits[0], F.lit(1.0)), F.coalesce(hits[3], hits[1], F.lit(10.0))
    return table(spark, sf_dir, "customer").select("c_custkey", gain.alias("gain"), hue.alias("hue"), sum(h.isNotNull().cast("bigint") for h in hits).alias("hits"))


_FILTERS = "f AS (SELECT p_brand AS print, p_type AS illuminant, p_size AS film, min(p_retailprice) AS c FROM part GROUP BY 1, 2, 3)"


@query(
    f"WITH {_FILTERS} SELECT l_suppkey, count(*) AS n, round(sum(coalesce(f.c, 1.0)), 4) AS c, count(*) FILTER (WHERE f.c IS NULL) AS missed FROM lineitem JOIN part p ON p.p_partkey = l_partkey LEFT JOIN (SELECT * FROM f WHERE film <= 25) f ON f.print = p.p_brand AND f.illuminant = p.p_type AND f.film = p.p_size GROUP BY l_suppkey"
)
def three_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up by three keys with a default; Spark sends the smaller side or shuffles by size."""
    part = table(spark, sf_dir, "part")
    filters = part.where("p_size <= 25").groupBy("p_brand", "p_type", "p_size").agg(F.min("p_retailprice").alias("c"))
    known = part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size").join(filters, ["p_brand", "p_type", "p_size"], "left").select("l_partkey", "c")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(known, "l_partkey")
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.coalesce("c", F.lit(1.0))), 4).alias("c"), F.count_if(F.col("c").isNull()).alias("missed"))


@query("SELECT event_id, round(power(2, 0.1 + 0.9 * (value / 100) + o.bias), 8) AS level FROM events LEFT JOIN (VALUES ('click', -0.5), ('view', 0.25), ('purchase', 0.5)) o(kind, bias) ON o.kind = event_type")
def settle_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A power law with an offset looked up by kind; null where the kind has none."""
    bias = F.try_element_at(F.create_map(*map(F.lit, ("click", -0.5, "view", 0.25, "purchase", 0.5))), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.round(F.pow(F.lit(2.0), 0.1 + 0.9 * (F.col("value") / 100) + bias), 8).alias("level"))


@query("WITH l AS (SELECT * FROM (VALUES (1, 1, 10.0), (2, 5, 20.0), (3, 15, CAST(NULL AS DOUBLE))) t(lens, lo, hi)) SELECT p_partkey, lens FROM part JOIN l ON p_size >= lo AND p_size <= coalesce(hi, 'Infinity'::DOUBLE)")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that hold a value, the upper end open where it is null; the three intervals are part of the plan."""
    lenses = F.array(*(F.struct(F.lit(a).alias("lens"), F.lit(lo).alias("lo"), F.lit(hi).cast("double").alias("hi")) for a, lo, hi in ((1, 1, 10.0), (2, 5, 20.0), (3, 15, None))))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    held = F.filter(lenses, lambda x: (F.col("p_size") >= x["lo"]) & (F.col("p_size") <= F.coalesce(x["hi"], F.lit(float("inf")))))
    return part.select("p_partkey", F.explode(held).alias("x")).select("p_partkey", "x.lens")


_SCORE = "a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey"


@query(
    "WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), s AS (SELECT a.p_partkey, b.p_partkey AS other, len(list_intersect(a.w, b.w)) AS score FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) SELECT p_partkey, arg_max(other, score * 1000000000 - other) AS best, CAST(max(score) AS INT) AS score FROM s WHERE score > 0 GROUP BY p_partkey"
)
def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each name the one of its brand that shares most words, the smallest key of equals.

    Names, not parts, are joined, and on words: a candidate is a name that shares a word at all. Of a name two keys are
    kept, as a part leaves out its own. ``fuzzy_best_all`` goes by the whole score.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("name"))
    least = Window.partitionBy("p_brand", "name").orderBy("p_partkey")
    keys = parts.withColumn("k", F.row_number().over(least)).where("k <= 2").groupBy("p_brand", "name").agg(F.collect_list("p_partkey").alias("keys"))
    words = keys.select("p_brand", "name", "keys", F.explode("name").alias("w"))
    shared = words.drop("keys").join(words.select("p_brand", "w", F.col("name").alias("other"), "keys"), ["p_brand", "w"])
    scored = shared.groupBy("p_brand", "name", "other").agg(F.count(F.lit(1)).cast("int").alias("score"), F.first("keys").alias("keys"))
    ranked = F.row_number().over(Window.partitionBy("p_brand", "name").orderBy(F.desc("score"), "best"))
    two = scored.select("p_brand", "name", "score", F.explode("keys").alias("best")).withColumn("k", ranked).where("k <= 2")
    two = two.groupBy("p_brand", "name").agg(F.array_sort(F.collect_list(F.struct("k", "best", "score"))).alias("two"))
    other = F.get(F.filter("two", lambda x: x["best"] != F.col("p_partkey")), F.lit(0))
    return parts.join(two, ["p_brand", "name"]).select("p_partkey", other.alias("x")).where("x is not null").select("p_partkey", "x.best", "x.score")


def best_matches(part: DataFrame) -> DataFrame:
    """For each part the other key of its brand whose name scores highest; the smallest key of equals.

    Scores are compared in order: exact (equal names, but for case and white space), contains (the other's letters and
    digits hold those of the name), score (words in common). Names are scored once a distinct (brand, name), whatever
    the number of parts that bear it: names that share a word or hold one another are joined on the word or the part
    held. Two keys of each name are kept, as a part leaves out its own. Parts without key, brand or word have no row.
    """
    clean = F.trim(F.regexp_replace(F.lower("p_name"), r"\s+", " "))
    parts = part.select("p_partkey", "p_brand", clean.alias("name")).where("p_partkey is not null and p_brand is not null and name <> ''")
    least = Window.partitionBy("p_brand", "name").orderBy("p_partkey")
    keys = parts.withColumn("k", F.dense_rank().over(least)).where("k <= 2").groupBy("p_brand", "name").agg(F.collect_set("p_partkey").alias("keys"))
    names = parts.select("p_brand", "name").distinct()
    words = names.select("p_brand", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("w"))
    shared = words.join(words.withColumnRenamed("name", "other"), ["p_brand", "w"]).select("p_brand", "name", "other", F.lit(0).alias("contains"), F.lit(1).alias("score"))
    compact = names.select("p_brand", "name", F.regexp_replace("name", r"[^\p{L}\p{N}]", "").alias("held")).where("held <> ''")
    begins = compact.select("p_brand", F.col("name").alias("other"), "held", F.explode(F.sequence(F.lit(1), F.length("held"))).alias("at"))
    ends = begins.select("p_brand", "other", "held", "at", F.explode(F.sequence(F.lit(1), F.length("held") - F.col("at") + 1)).alias("n"))
    inside = ends.select("p_brand", "other", F.substring("held", F.col("at"), F.col("n")).alias("held")).distinct()
    holds = compact.join(inside, ["p_brand", "held"]).select("p_brand", "name", "other", F.lit(1).alias("contains"), F.lit(0).alias("score"))
    scored = shared.union(holds).groupBy("p_brand", "name", "other").agg(F.max("contains").alias("contains"), F.sum("score").cast("int").alias("score"))
    others = scored.join(keys.withColumnRenamed("name", "other"), ["p_brand", "other"])
    value = F.struct((F.col("name") == F.col("other")).cast("int").alias("exact"), "contains", "score")
    each = others.select("p_brand", "name", value.alias("s"), F.explode("keys").alias("best")).groupBy("p_brand", "name", "best").agg(F.max("s").alias("s"))
    top = F.row_number().over(Window.partitionBy("p_brand", "name").orderBy(F.desc("s"), "best"))
    two = each.withColumn("k", top).where("k <= 2").groupBy("p_brand", "name").agg(F.array_sort(F.collect_list(F.struct("k", "s", "best"))).alias("two"))
    own = parts.join(two, ["p_brand", "name"]).select("p_partkey", F.get(F.filter("two", lambda x: x["best"] != F.col("p_partkey")), F.lit(0)).alias("x")).where("x is not null")
    found = own.groupBy("p_partkey").agg(F.max(F.struct("x.s", (-F.col("x.best")).alias("minus"))).alias("y"))
    return found.select("p_partkey", (-F.col("y.minus")).alias("best"), "y.s.exact", "y.s.contains", "y.s.score")


@query()
def fuzzy_best_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every part. Without SQL: all pairs of a brand are too many; the tests compare with brute force."""
    return best_matches(table(spark, sf_dir, "part"))


@query(f"WITH {CAT}, r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq DESC) AS k FROM cat) SELECT bucket, seq, rel FROM r WHERE k <= 24")
def lru_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 24 of each bucket; Spark keeps 24 of each partition before it shuffles."""
    k = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("seq")))
    return catalogue(spark, sf_dir).withColumn("k", k).where("k <= 24").select("bucket", "seq", "rel")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def limit_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25, with the number of all."""
    o = table(spark, sf_dir, "orders")
    first = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")
    return first.crossJoin(o.agg(F.count(F.lit(1)).alias("total")))  # one row on the right


@query(f"WITH {CAT}, {RATE} SELECT rel, star AS bucket FROM rate EXCEPT SELECT rel, priority FROM cat")
def bucket_sync_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desired state without the actual one."""
    actual = catalogue(spark, sf_dir).select("rel", F.col("priority").alias("bucket"))
    return ratings(spark, sf_dir).select("rel", F.col("star").alias("bucket")).subtract(actual)


@query(f"WITH {CAT}, {RATE} SELECT rel, priority AS bucket FROM cat EXCEPT SELECT rel, star FROM rate")
def bucket_sync_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = catalogue(spark, sf_dir).select("rel", F.col("priority").alias("bucket"))
    return actual.subtract(ratings(spark, sf_dir).select("rel", F.col("star").alias("bucket")))


@query(f"WITH {CAT}, root AS (SELECT DISTINCT rel FROM cat WHERE priority = 1), b AS (SELECT DISTINCT bucket, rel FROM cat WHERE priority > 1) SELECT (SELECT count(*) FROM root) + count(*) AS keys, count(DISTINCT bucket) AS buckets FROM b WHERE rel NOT IN (SELECT rel FROM root)")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the root, and those of each bucket that the root lacks; a key in two buckets counts twice."""
    cat = catalogue(spark, sf_dir)
    root = cat.where("priority = 1").select("rel").distinct()
    rest = cat.where("priority > 1").select("bucket", "rel").distinct().join(root, "rel", "left_anti")
    counted = rest.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bucket").alias("buckets"))
    return counted.crossJoin(root.agg(F.count(F.lit(1)).alias("m"))).select((F.col("n") + F.col("m")).alias("keys"), "buckets")  # single rows


@query("SELECT user_id, arg_max(event_id, value * 1000000 - event_id / 1e9) AS best FROM events WHERE value > 20 AND event_type <> 'view' AND value < 400 GROUP BY user_id")
def gated_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what passes three gates the largest, the first of equals."""
    ok = table(spark, sf_dir, "events").where("value > 20 and event_type <> 'view' and value < 400")
    return ok.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("e"))).alias("best"))


@query("WITH k AS (SELECT page_id, url, row_number() OVER (PARTITION BY lower(url) ORDER BY page_id) AS n FROM pages) SELECT page_id, CASE WHEN n = 1 THEN url ELSE url || ' ·' || CAST(n AS VARCHAR) END AS name FROM k")
def unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by a number from the second on, whatever their case."""
    n = F.row_number().over(Window.partitionBy(F.lower("url")).orderBy("page_id"))
    return table(spark, sf_dir, "pages").withColumn("n", n).select("page_id", F.when(F.col("n") == 1, F.col("url")).otherwise(F.concat("url", F.lit(" ·"), F.col("n").cast("string"))).alias("name"))


@query("WITH s AS (SELECT DISTINCT source, regexp_extract(source, '^[^0-9]*') AS head, CAST(regexp_extract(source, '[0-9]+') AS INT) AS number FROM documents) SELECT source, CAST(row_number() OVER (ORDER BY head, number, source) AS INT) AS place FROM s")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the order of their letters, then of their number. The window runs over distinct names only."""
    s = table(spark, sf_dir, "documents").select("source").distinct().select("source", F.regexp_extract("source", "^[^0-9]*", 0).alias("head"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("number"))
    return s.select("source", F.row_number().over(Window.orderBy("head", "number", "source")).alias("place"))


_EXIF = "x AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS focal, p_size * 7 / 10.0::DOUBLE AS fnum, CAST(p_size * p_size * 3 AS DOUBLE) AS exp, CAST((p_partkey % 7 - 3) / 3.0 AS DOUBLE) AS bias, '2024:' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || ':05 10:00' AS dt FROM part)"


@query(
    f"""WITH {_EXIF} SELECT p_partkey, printf('%.1f mm', focal) AS focal, 'ƒ/' || printf('%.1f', floor(fnum * 100 + 0.5) / 100) AS aperture, CASE WHEN exp = 0 THEN NULL WHEN 1 / exp < 0.001 THEN '1/' || CAST(CAST(floor(exp + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', 1 / exp) || 's' END AS shutter,
CASE WHEN bias > 0 THEN '+' ELSE '' END || printf('%.2f', bias) || ' EV' AS bias, regexp_replace(dt, '^(\\d{{4}}):(\\d{{2}}):(\\d{{2}})', '\\1-\\2-\\3') AS time FROM x"""
)
def exif_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's numbers as a reader wants them: focal length, aperture, shutter time, exposure bias and time."""
    size, key = F.col("p_size"), F.col("p_partkey")
    two = F.lpad((F.pmod(size, F.lit(12)) + 1).cast("string"), 2, "0")
    x = table(spark, sf_dir, "part").select(key, size.alias("focal"), (size * 7 / 10.0).alias("fnum"), (size * size * 3.0).alias("exp"), ((F.pmod(key, F.lit(7)) - 3) / 3.0).alias("bias"), F.concat(F.lit("2024:"), two, F.lit(":05 10:00")).alias("dt"))
    seconds = F.try_divide(F.lit(1.0), F.col("exp"))
    shutter = F.when(seconds < 0.001, F.concat(F.lit("1/"), F.floor(F.col("exp") + 0.5).cast("string"))).otherwise(F.concat(F.format_string("%.1f", seconds), F.lit("s")))
    bias = F.concat(F.when(F.col("bias") > 0, "+").otherwise(""), F.format_string("%.2f", F.col("bias")), F.lit(" EV"))
    aperture = F.concat(F.lit("ƒ/"), F.format_string("%.1f", F.floor(F.col("fnum") * 100 + 0.5) / 100))
    return x.select("p_partkey", F.format_string("%.1f mm", F.col("focal").cast("double")).alias("focal"), aperture.alias("aperture"), F.when(F.col("exp") != 0, shutter).alias("shutter"), bias.alias("bias"), F.regexp_replace("dt", r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3").alias("time"))
