"""Names, paths, settings and states: text rules over catalogues of files, as maps and keyed aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specula.plans.registry import query
from specula.sources.tables import CAT, FILES, RATE, catalogue, files, ratings, table

_EXT = r"(\.[^.]+)$"
RAW, STD = (".raf", ".dng"), (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def _listed(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_KIND = f"CASE WHEN lower(regexp_extract(name, '(\\.[^.]+)$', 1)) IN {_listed(RAW)} THEN 'raw' WHEN lower(regexp_extract(name, '(\\.[^.]+)$', 1)) IN {_listed(STD)} THEN 'std' END"


def _kind():
    end = F.lower(F.regexp_extract("name", _EXT, 1))
    return F.when(end.isin(*RAW), "raw").when(end.isin(*STD), "std")


def _stem(name: str = "name"):
    return F.regexp_replace(name, r"\.[^.]+$", "")


@query(f"WITH {FILES} SELECT file_id, {_KIND} AS kind FROM files")
def kind_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw or standard by a name's ending; null for others."""
    return files(spark, sf_dir).select("file_id", _kind().alias("kind"))


@query(f"WITH {FILES} SELECT rtrim(dir, '/') AS dir, CAST(len(string_split(rtrim(dir, '/'), '/')) - 2 AS INT) AS depth, count(*) AS n FROM files WHERE NOT starts_with(list_extract(string_split(dir, '/'), -2), '.') GROUP BY 1, 2 HAVING CAST(len(string_split(rtrim(dir, '/'), '/')) - 2 AS INT) <= 2")
def dir_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders at most two levels below the library, hidden ones left out, with their files."""
    folder = F.rtrim(F.col("dir"), F.lit("/"))
    df = files(spark, sf_dir).select(folder.alias("dir")).withColumn("depth", F.size(F.split("dir", "/")) - 2)
    return df.where(~F.startswith(F.element_at(F.split("dir", "/"), -1), F.lit(".")) & (F.col("depth") <= 2)).groupBy("dir", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILES} SELECT file_id, upper(regexp_replace(name, '\\.[^.]+$', '')) AS rel, name, rtrim(dir, '/') AS dir FROM files WHERE {_KIND} IS NOT NULL")
def list_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos of folders by identity, name and folder."""
    return files(spark, sf_dir).where(_kind().isNotNull()).select("file_id", F.upper(_stem()).alias("rel"), "name", F.rtrim(F.col("dir"), F.lit("/")).alias("dir"))


@query(f"WITH {FILES} SELECT lower(dir || name) AS path, min(file_id) AS file_id FROM files WHERE NOT contains(dir, '/PROMO') GROUP BY 1")
def expand_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of inputs, once whatever their case, the first of each; what lies below the output folder is left out."""
    df = files(spark, sf_dir).where(~F.contains("dir", F.lit("/PROMO")))
    return df.groupBy(F.lower(F.concat("dir", "name")).alias("path")).agg(F.min("file_id").alias("file_id"))


@query("SELECT page_id, md5(substr(html, 1, 4096)) AS head, CAST(least(length(html), 4096) AS INT) AS n FROM pages")
def prefix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginning of each file, as far as a header can reach."""
    head = F.substring("html", 1, 4096)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(head.cast("binary")).alias("head"), F.length(head).alias("n"))


@query("SELECT event_id, coalesce(CAST(nullif(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1), '') AS BIGINT), 1) AS k, CAST(7 AS BIGINT) AS q, CAST(2 AS INT) AS settings FROM events")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings: defaults, overridden by what a document sets."""
    own = F.from_json("props", "map<string,bigint>")
    defaults = F.create_map(F.lit("k"), F.lit(1).cast("bigint"), F.lit("q"), F.lit(7).cast("bigint"))
    merged = F.map_zip_with(defaults, F.coalesce(own, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))), lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf_dir, "events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["q"].alias("q"), F.size("m").alias("settings"))


@query("SELECT event_id, CASE WHEN value >= 10 THEN value END AS first, CAST(CASE WHEN value >= 10 THEN 2 ELSE 1 END AS INT) AS known FROM events")
def nan_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are none become nulls, in arrays too, so that JSON can hold them."""
    values = F.array(F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value")), F.col("value"))
    safe = F.transform(values, lambda x: F.when(~F.isnan(x), x))
    back = F.from_json(F.to_json(F.struct(safe.alias("v"))), "v array<double>")["v"]
    return table(spark, sf_dir, "events").select("event_id", back.alias("v")).select("event_id", F.get("v", F.lit(0)).alias("first"), F.size(F.filter("v", lambda x: x.isNotNull())).alias("known"))


@query("SELECT p_brand AS print, p_type AS illuminant, CAST(p_size AS VARCHAR) AS film, round(min(p_retailprice), 2) AS c FROM part GROUP BY 1, 2, 3")
def json_map3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of three levels, one JSON document a first key, written and read back as rows."""
    one = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("print"), F.col("p_type").alias("illuminant"), F.col("p_size").cast("string").alias("film")).agg(F.round(F.min("p_retailprice"), 2).alias("c"))
    two = one.groupBy("print", "illuminant").agg(F.map_from_entries(F.collect_list(F.struct("film", "c"))).alias("films"))
    three = two.groupBy("print").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("illuminant", "films")))).alias("doc"))
    read = three.select("print", F.explode(F.from_json("doc", "map<string,map<string,double>>")).alias("illuminant", "films"))
    return read.select("print", "illuminant", F.explode("films").alias("film", "c"))


@query("SELECT c_mktsegment AS name, '| ' || c_mktsegment || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || CAST(CAST(floor(sum(c_acctbal)) AS BIGINT) AS VARCHAR) || ' |' AS line FROM customer GROUP BY c_mktsegment")
def text_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report's table."""
    df = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum("c_acctbal")).alias("total"))
    return df.select("name", F.format_string("| %s | %d | %d |", "name", "n", "total").alias("line"))


@query(f"WITH {FILES} SELECT file_id, lower(regexp_replace(replace(dir, '/', '\\'), '\\\\+$', '')) AS path, regexp_replace(trim(dir), '[\\\\/:*?\"<>|]', '_', 'g') AS slug, concat_ws('/', '.', 'debug', regexp_replace(trim(name), '[\\\\/:*?\"<>|]', '_', 'g')) AS debug FROM files")
def norm_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in the form in which they are compared, and safe names of folders made from any text."""
    slug = lambda c: F.regexp_replace(F.trim(c), r'[\\/:*?"<>|]', "_")
    path = F.lower(F.regexp_replace(F.replace(F.col("dir"), F.lit("/"), F.lit("\\")), r"\\+$", ""))
    return files(spark, sf_dir).select("file_id", path.alias("path"), slug("dir").alias("slug"), F.concat_ws("/", F.lit("."), F.lit("debug"), slug("name")).alias("debug"))


@query(f"WITH {FILES}, raw AS (SELECT dir, upper(regexp_replace(name, '\\.[^.]+$', '')) AS rel, min(name) AS name FROM files WHERE {_KIND} = 'raw' GROUP BY 1, 2), k AS (SELECT DISTINCT dir, upper(regexp_replace(name, '\\.[^.]+$', '')) AS rel FROM files) SELECT k.dir, k.rel, coalesce(regexp_replace(raw.name, '\\.[^.]+$', ''), k.rel) || '.JPG' AS bucket FROM k LEFT JOIN raw USING (dir, rel)")
def bucket_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a key's copy: that of its raw file where there is one, else the key."""
    rel = F.upper(_stem())
    raw = F.min(F.when(_kind() == "raw", F.col("name")))
    df = files(spark, sf_dir).groupBy("dir", rel.alias("rel")).agg(raw.alias("raw"))
    return df.select("dir", "rel", F.concat(F.coalesce(_stem("raw"), F.col("rel")), F.lit(".JPG")).alias("bucket"))


_VERSION = "v AS (SELECT o_orderkey, CAST(o_orderkey % 3 AS VARCHAR) || '.' || CAST(o_orderkey % 7 AS VARCHAR) || '.' || CAST(o_custkey % 11 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '.dev' || CAST(o_custkey AS VARCHAR) ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '+abc.1' ELSE '' END AS version FROM orders)"


@query(f"WITH {_VERSION} SELECT o_orderkey, 'v' || array_to_string(list_filter(string_split(string_split(string_split(version, '+')[1], '.dev')[1], '.'), lambda x: regexp_full_match(x, '[0-9]+')), '') AS version FROM v")
def normalize_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version's groups of digits without development and local suffixes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    version = F.concat(text(k % 3), F.lit("."), text(k % 7), F.lit("."), text(c % 11), F.when(k % 2 == 0, F.concat(F.lit(".dev"), text(c))).otherwise(""), F.when(k % 5 == 0, "+abc.1").otherwise(""))
    base = F.substring_index(F.substring_index(version, "+", 1), ".dev", 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("v"), F.array_join(F.filter(F.split(base, r"\."), lambda g: g.rlike("^[0-9]+$")), "")).alias("version"))


@query(f"WITH {CAT} SELECT rel, 'S' || bucket || '||' || CAST(rel AS VARCHAR) AS name FROM (SELECT DISTINCT rel, bucket FROM cat)")
def migrate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an old form, folder||name.ext, without their ending; one without an ending stays, so a second run changes nothing."""
    old = F.concat(F.lit("S"), F.col("bucket"), F.lit("||"), F.col("rel").cast("string"), F.when(F.col("rel") % 2 == 0, ".jpg").otherwise(""))
    last = F.substring_index(F.col("old"), "||", -1)
    head = F.substring("old", F.lit(1), F.length("old") - F.length(last))
    once = lambda df: df.withColumn("old", F.concat(head, F.upper(F.regexp_replace(last, r"\.[^.]+$", ""))))
    return once(once(catalogue(spark, sf_dir).select("rel", "bucket").distinct().withColumn("old", old))).select("rel", F.col("old").alias("name"))


@query(f"WITH {FILES} SELECT file_id, array_slice(regexp_replace(list_extract(string_split(rtrim(dir, '/'), '/'), -1), '[<>:\"/\\\\|?*]', '_', 'g'), 1, 24) || '@' || substr(sha1(lower(replace(rtrim(dir, '/'), '\\', '/'))), 1, 8) AS index_dir, md5(dir || name || '|' || '256') AS thumb FROM files")
def hash_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a folder's index and of a picture's small copy, by hashes of what they stand for."""
    folder = F.rtrim(F.col("dir"), F.lit("/"))
    base = F.substring(F.regexp_replace(F.substring_index(folder, "/", -1), r'[<>:"/\\|?*]', "_"), 1, 24)
    short = F.substring(F.sha1(F.lower(F.replace(folder, F.lit("\\"), F.lit("/"))).cast("binary")), 1, 8)
    return files(spark, sf_dir).select("file_id", F.concat(base, F.lit("@"), short).alias("index_dir"), F.md5(F.concat("dir", "name", F.lit("|256")).cast("binary")).alias("thumb"))


@query("SELECT event_id, event_id % 4 <> 0 AS ok, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS n, CASE WHEN event_id % 4 = 0 THEN 'no result line' END AS error FROM events")
def marker_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result that a tool's output has behind a marker, or a row that says that it has none."""
    log = F.concat(F.lit("step 1\n"), F.when(F.col("event_id") % 4 == 0, "").otherwise("INDEX_OK  "), F.col("props"), F.lit("\nbye"))
    found = F.regexp_extract(log, r"INDEX_OK\s+(\{[^\n]*\})", 1)
    n = F.from_json(F.nullif(found, F.lit("")), "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", (found != "").alias("ok"), F.coalesce(n, F.lit(0)).alias("n"), F.when(found == "", "no result line").alias("error"))


@query("WITH q AS (SELECT page_id, list_extract(string_split(url, '?'), 2) AS q FROM pages), k AS (SELECT page_id, coalesce(nullif(q, ''), '(none)') AS q FROM q) SELECT page_id, array_to_string(list_transform(string_split(q, '&'), lambda x: CASE WHEN starts_with(x, 'ref=') THEN 'ref=' || list_extract(string_split(substr(x, 5), '/'), -1) ELSE x END), '&')[1:24] AS q FROM k")
def query_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query string with paths cut to their last part, no longer than a log line may be."""
    q = F.coalesce(F.nullif(F.get(F.split("url", r"\?"), F.lit(1)), F.lit("")), F.lit("(none)"))
    part = lambda x: F.when(F.startswith(x, F.lit("ref=")), F.concat(F.lit("ref="), F.substring_index(F.replace(x, F.lit("ref="), F.lit("")), "/", -1))).otherwise(x)
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.array_join(F.transform(F.split(q, "&"), part), "&"), 1, 24).alias("q"))


@query("SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) = 0 AS missing FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey GROUP BY c_custkey")
def missing_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root with what it holds; one without anything is flagged, not dropped."""
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(held, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query(f"WITH {RATE}, edits AS (SELECT o_custkey AS rel, CAST(arg_max(o_orderkey % 7 - 1, o_orderkey) AS INT) AS star FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT coalesce(e.rel, r.rel) AS rel, coalesce(e.star, r.star) AS star FROM rate r FULL JOIN edits e USING (rel) WHERE coalesce(e.star, r.star) > 0")
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings after edits: the last edit of a key wins, none or less than one star takes the key out."""
    edits = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("rel")).agg(F.max_by(F.col("o_orderkey") % 7 - 1, "o_orderkey").cast("int").alias("new"))
    merged = ratings(spark, sf_dir).join(edits, "rel", "full").select("rel", F.coalesce("new", "star").alias("star"))
    return merged.where("star > 0")


@query(f"WITH {CAT}, {RATE}, k AS (SELECT DISTINCT rel FROM cat), s AS (SELECT coalesce(star, 0) AS star FROM k LEFT JOIN rate USING (rel)) SELECT count(*) AS every, {', '.join(f'count(*) FILTER (WHERE star = {n}) AS {name}' for n, name in enumerate(('unrated', 'one', 'two', 'three', 'four', 'five')))}, count(*) FILTER (WHERE star >= 1) AS rated FROM s")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many photos each filter would show, in one pass."""
    keys = catalogue(spark, sf_dir).select("rel").distinct().join(ratings(spark, sf_dir), "rel", "left").select(F.coalesce("star", F.lit(0)).alias("star"))
    star = F.col("star")
    return keys.agg(F.count(F.lit(1)).alias("every"), *(F.count_if(star == n).alias(name) for n, name in enumerate(("unrated", "one", "two", "three", "four", "five"))), F.count_if(star >= 1).alias("rated"))


@query("SELECT p_partkey, sha256('brand=' || p_brand || ';name=' || p_name || ';size=' || CAST(p_size AS VARCHAR)) AS hash FROM part")
def param_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of parameters that doesn't depend on their order."""
    given = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    line = F.array_join(F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(line, 256).alias("hash"))


@query("SELECT p_brand AS name, CAST(row_number() OVER (ORDER BY p_brand DESC) AS INT) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names, last first, by code units. The window runs over distinct names only."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(F.desc("name"))).alias("place"))


@query(f"WITH {FILES}, o AS (SELECT file_id, dir || name AS src, dir || regexp_replace(name, '\\.[^.]+$', '') || '.JPG' AS out, {_KIND} AS kind FROM files) SELECT file_id, out, kind IS NOT NULL AND src <> out AS ok, CASE WHEN kind IS NULL THEN 'unknown kind' WHEN src = out THEN 'would overwrite its input' END AS error FROM o")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item of a batch with its output's name, or why it has none; an output never overwrites its input."""
    src, out = F.concat("dir", "name"), F.concat("dir", _stem(), F.lit(".JPG"))
    error = F.when(_kind().isNull(), "unknown kind").when(src == out, "would overwrite its input")
    return files(spark, sf_dir).select("file_id", out.alias("out"), error.isNull().alias("ok"), error.alias("error"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN '-' ELSE event_type END AS back, CASE WHEN event_id % 5 = 0 THEN '-' WHEN value > 100 THEN '过曝' ELSE '正常' END AS overwhite, concat_ws(' · ', CASE WHEN value > 50 THEN 'high' ELSE 'low' END, nullif(event_type, 'view'), CASE WHEN event_id % 5 <> 0 AND value > 100 THEN '源头过曝' END) AS label FROM events")
def scene_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for the axes of a scene, a dash for what isn't known, and a label of what is."""
    back = F.nullif("event_type", F.lit("view"))
    white = F.when(F.col("event_id") % 5 != 0, F.col("value") > 100)
    label = F.concat_ws(" · ", F.when(F.col("value") > 50, "high").otherwise("low"), back, F.when(white, "源头过曝"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(back, F.lit("-")).alias("back"), F.when(white, "过曝").when(~white, "正常").otherwise("-").alias("overwhite"), label.alias("label"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 1 THEN CASE WHEN m IN (100, 200, 400) THEN m END WHEN p_size % 3 = 0 THEN CASE WHEN a IN (100, 200, 400) THEN a END ELSE coalesce(CASE WHEN m IN (100, 200, 400) THEN m END, CASE WHEN a IN (100, 200, 400) THEN a END) END AS DOUBLE) AS dr FROM (SELECT p_partkey, p_size, (p_partkey % 5) * 100 AS m, (p_size % 7) * 100 AS a FROM part)")
def dr_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's dynamic range: by its mode the manual or the automatic tag; either, if the mode isn't known; valid values only."""
    mode, manual, auto = F.col("p_size") % 3, (F.col("p_partkey") % 5) * 100, (F.col("p_size") % 7) * 100
    valid = lambda c: F.when(c.isin(100, 200, 400), c)
    dr = F.when(mode == 1, valid(manual)).when(mode == 0, valid(auto)).otherwise(F.coalesce(valid(manual), valid(auto)))
    return table(spark, sf_dir, "part").select("p_partkey", dr.cast("double").alias("dr"))


@query("WITH r AS (SELECT p_partkey, abs((p_partkey % 11 - 5) / nullif(CAST(p_size % 4 AS DOUBLE), 0)) AS v FROM part) SELECT p_partkey, round(CASE WHEN v BETWEEN 0.05 AND 4.0 THEN v END, 8) AS ev FROM r")
def ratio_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a ratio where it is one and can be true, else null."""
    v = F.abs(F.try_divide((F.col("p_partkey") % 11 - 5).cast("double"), (F.col("p_size") % 4).cast("double")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.when(v.between(0.05, 4.0), v), 8).alias("ev"))


@query("SELECT p_partkey, CASE WHEN p_size % 8 + 1 >= 5 THEN 4000 ELSE 6000 END AS width, CASE WHEN p_size % 8 + 1 >= 5 THEN 6000 ELSE 4000 END AS height FROM part")
def orient_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height as shown: orientations 5 to 8 lie on their side."""
    side = F.pmod("p_size", F.lit(8)) + 1 >= 5
    return table(spark, sf_dir, "part").select("p_partkey", F.when(side, 4000).otherwise(6000).alias("width"), F.when(side, 6000).otherwise(4000).alias("height"))


@query("WITH reg AS (SELECT n_name AS name, substr(n_name, 1, 3) || CAST(n_nationkey AS VARCHAR) AS tag, n_nationkey FROM nation), asked AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n.n_name ELSE substr(n.n_name, 1, 3) || CAST(n.n_nationkey AS VARCHAR) END AS q FROM customer JOIN nation n ON n.n_nationkey = c_nationkey) SELECT c_custkey, min(reg.n_nationkey) AS found FROM asked LEFT JOIN reg ON q = reg.name OR q = reg.tag GROUP BY c_custkey")
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry looked up by its name or by its tag: one join over both keys."""
    nation = table(spark, sf_dir, "nation")
    tag = F.concat(F.substring("n_name", 1, 3), F.col("n_nationkey").cast("string"))
    keys = nation.select(F.explode(F.array_distinct(F.array("n_name", tag))).alias("q"), F.col("n_nationkey").alias("found")).groupBy("q").agg(F.min("found").alias("found"))
    asked = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(tag).alias("q"))
    return asked.join(keys, "q", "left").select("c_custkey", "found")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'a/' WHEN c_acctbal > 0 THEN 'b/' ELSE 'c/' END || c_name AS dir FROM customer")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidate folders that is there."""
    there = lambda test, folder: F.when(test, F.concat(F.lit(folder), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(there(F.col("c_acctbal") > 5000, "a/"), there(F.col("c_acctbal") > 0, "b/"), there(F.lit(True), "c/")).alias("dir"))


@query("SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS value, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) IS NULL AS missing FROM events")
def dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a document by its dotted path."""
    doc = F.from_json(F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit("}}")), "a struct<b: struct<k: bigint>>")
    return table(spark, sf_dir, "events").select("event_id", doc.alias("doc")).select("event_id", F.col("doc.a.b.k").alias("value"), F.col("doc.a.b.k").isNull().alias("missing"))
