"""Queries on names, identifiers, units, registries, manifests and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from axonlake.functions import names as nm
from axonlake.functions import registry as rg
from axonlake.operators import boxes as bx
from axonlake.operators import objects as ob
from axonlake.sources import tables as st

from .views import query, r6, table

# Stimulus names made from parts: a base name and a concentration in one of five forms.
STIM = """stim AS (SELECT p_partkey AS id, split_part(p_type, ' ', 1) || ' ' || CASE p_partkey % 5 WHEN 0 THEN p_size || 'mM' WHEN 1 THEN p_size || 'uM' WHEN 2 THEN 'E' || (p_size % 9)
WHEN 3 THEN p_size || '%' ELSE 'plain' END AS name, 'c' || (p_size % 7 + 1) || '_' || (p_partkey % 12) AS code FROM part)"""


def _stim(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    s = F.col("p_size").cast("string")
    unit = F.when(k == 0, F.concat(s, F.lit("mM"))).when(k == 1, F.concat(s, F.lit("uM"))).when(k == 2, F.concat(F.lit("E"), (F.col("p_size") % 9).cast("string"))).when(k == 3, F.concat(s, F.lit("%"))).otherwise("plain")
    name = F.concat_ws(" ", F.split_part("p_type", F.lit(" "), F.lit(1)), unit)
    code = F.concat(F.lit("c"), (F.col("p_size") % 7 + 1).cast("string"), F.lit("_"), (F.col("p_partkey") % 12).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), code.alias("code"))


CONC = """CASE WHEN regexp_matches(name, '[\\d.]+\\s*%') THEN 0 WHEN regexp_matches(name, '(?i)[\\d.]+\\s*uM') THEN 1 WHEN regexp_matches(name, '(?i)[\\d.]+\\s*mM') THEN 2 WHEN regexp_matches(name, '(?i)E-?\\d+') THEN 3 END AS prio,
CASE WHEN regexp_matches(name, '[\\d.]+\\s*%') THEN TRY_CAST(regexp_extract(name, '([\\d.]+)\\s*%', 1) AS DOUBLE) WHEN regexp_matches(name, '(?i)[\\d.]+\\s*uM') THEN TRY_CAST(regexp_extract(name, '(?i)([\\d.]+)\\s*uM', 1) AS DOUBLE)
WHEN regexp_matches(name, '(?i)[\\d.]+\\s*mM') THEN TRY_CAST(regexp_extract(name, '(?i)([\\d.]+)\\s*mM', 1) AS DOUBLE) WHEN regexp_matches(name, '(?i)E-?\\d+') THEN -TRY_CAST(regexp_extract(name, '(?i)E(-?\\d+)', 1) AS DOUBLE) END AS value"""


@query(f"WITH {STIM} SELECT id, {CONC} FROM stim")
def concentration_parse(spark, d):
    s = _stim(spark, d).withColumn("c", nm.concentration(F.col("name")))
    return s.select("id", F.col("c.prio").alias("prio"), (F.col("c.value") + F.lit(0.0)).alias("value"))


@query(
    f"""WITH {STIM}, c AS (SELECT id, code, name, split_part(name, ' ', 1) AS grp, split_part(name, ' ', 2) AS variant, {CONC} FROM stim)
SELECT id, grp AS "group", variant, row_number() OVER (PARTITION BY grp ORDER BY prio NULLS LAST, value, id) AS place FROM c"""
)
def name_split_sort(spark, d):
    """Groups and places by concentration; names without one come last."""
    s = _stim(spark, d).withColumn("s", nm.split_name(F.col("name"))).withColumn("c", nm.concentration(F.col("name")))
    order = W.partitionBy("s.group").orderBy(F.col("c.prio").asc_nulls_last(), F.col("c.value"), "id")
    return s.select("id", F.col("s.group").alias("group"), F.col("s.variant").alias("variant"), F.row_number().over(order).cast("long").alias("place"))


@query(
    f"""WITH {STIM} SELECT id, regexp_extract(code, '^([A-Za-z])', 1) AS prefix, CAST(regexp_extract(code, '^[A-Za-z](\\d+)_', 1) AS INT) AS batch, CAST(regexp_extract(code, '_(\\d+)$', 1) AS INT) AS "index",
row_number() OVER (ORDER BY CAST(regexp_extract(code, '^[A-Za-z](\\d+)_', 1) AS INT), CAST(regexp_extract(code, '_(\\d+)$', 1) AS INT), id) AS place FROM stim"""
)
def id_parse(spark, d):
    """Parts of an id and its natural place; the places are counted within batches, offset by the batches before."""
    s = _stim(spark, d).withColumn("p", nm.stimulus_id(F.col("code"))).select("id", "p.*")
    n = s.groupBy("batch").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("batch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("batch").orderBy("index", "id"))
    return s.join(F.broadcast(before.select("batch", "before")), "batch").select("id", "prefix", "batch", "index", (place + F.col("before")).cast("long").alias("place"))


@query("""SELECT c_custkey AS id, coalesce(nullif(regexp_extract(c_name, '([wW][0-9]+)', 1), ''), 'NoWORM') AS plain, coalesce(nullif(regexp_extract('W' || c_custkey || '_x', '([wW][0-9]+)', 1), ''), 'NoWORM') AS worm FROM customer""")
def worm_id(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), nm.worm_id(F.col("c_name")).alias("plain"), nm.worm_id(F.concat(F.lit("W"), F.col("c_custkey").cast("string"), F.lit("_x"))).alias("worm"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN '202510' ELSE strftime(o_orderdate, '%Y%m') END AS month FROM orders""")
def folder_month(spark, d):
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.concat(F.lit("w"), F.col("o_orderkey").cast("string"), F.lit("_"), F.when(F.col("o_orderkey") % 10 == 0, "bad").otherwise(day), F.lit("_10-21-21"))
    return o.select(F.col("o_orderkey").alias("id"), nm.folder_month(name).alias("month"))


@query(
    """SELECT p_partkey AS id, round(p_retailprice / 180.16 / (p_size + 1) * 1e6, 3) AS diluted, round((p_retailprice / 1000 / 342.3) / ((p_size + 1) / 1000.0) * 1e6, 3) AS mixed,
CASE WHEN p_retailprice / 10 >= 1000 THEN printf('%.2f mM', p_retailprice / 10 / 1000) WHEN p_retailprice / 1500 >= 1 THEN printf('%.2f µM', p_retailprice / 1500) ELSE printf('%.2f nM', p_retailprice / 1500 * 1000) END AS label FROM part"""
)
def unit_convert(spark, d):
    p = table(spark, d, "part")
    price, n = F.col("p_retailprice"), F.col("p_size") + 1
    return p.select(
        F.col("p_partkey").alias("id"), F.round(nm.dilution_to_um(F.lit(180.16), price, n), 3).alias("diluted"), F.round(nm.mass_ratio_to_um(F.lit(342.3), price, n), 3).alias("mixed"), nm.format_um(price / 1500).alias("label")
    )


@query("SELECT event_id, [CAST(json_extract(props, '$.k') AS INT) >> b & 1 for b in range(7)] AS bits FROM events".replace("[CAST", "list_transform(range(7), lambda b: CAST((CAST").replace(" >> b & 1 for b in range(7)]", " >> CAST(b AS INT)) & 1 AS INT))"))
def state_bits(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", nm.bits(k, 7).alias("bits"))


@query("SELECT c_custkey AS id, '#' || left(md5(c_name), 6) AS color, replace(replace(replace(c_mktsegment || ' a/b', '/', '_'), '\\', '_'), ' ', '_') AS file, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS padded FROM customer")
def name_colors(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), nm.name_colour(F.col("c_name")).alias("color"), nm.safe_file_name(F.concat(F.col("c_mktsegment"), F.lit(" a/b"))).alias("file"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("padded"))


@query(
    f"""WITH {STIM} SELECT id, CASE WHEN contains(name, ' E') THEN 'E' || split_part(name, ' E', 2) WHEN length(split_part(name, ' ', 2)) > 3 THEN left(split_part(name, ' ', 2), 3) || '.' ELSE split_part(name, ' ', 2) END AS label FROM stim"""
)
def short_labels(spark, d):
    return _stim(spark, d).select("id", nm.short_label(F.col("name"), F.col("code")).alias("label"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name END AS name, CASE WHEN s_suppkey % 2 = 0 THEN chr(CAST(97 + s_suppkey % 26 AS INT)) END AS prefix FROM supplier")
def prefix_tokens(spark, d):
    s = table(spark, d, "supplier")
    text = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.col("s_name"), F.lit(" "), F.upper(F.char(97 + F.col("s_suppkey") % 26)))).otherwise(F.col("s_name"))
    return s.withColumn("p", nm.prefix_token(text)).select(F.col("s_suppkey").alias("id"), F.col("p.name").alias("name"), F.col("p.prefix").alias("prefix"))


@query(
    """SELECT n_nationkey AS id, n_name AS meaning FROM nation WHERE NOT contains(lower(n_name), 'an') AND NOT contains(lower(n_name), 'us')"""
)
def stimulus_channels(spark, d):
    n = table(spark, d, "nation")
    return n.where(nm.is_stimulus_channel(F.col("n_name"), ("an", "us"))).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("meaning"))


@query(
    """WITH p AS (SELECT id, [CAST((id >> 4) & 1 AS INT), CAST((id >> 3) & 1 AS INT), CAST((id >> 2) & 1 AS INT), CAST((id >> 1) & 1 AS INT), CAST(id & 1 AS INT)] AS p FROM range(32) r(id)),
x AS (SELECT 1 AS rank, [1, 1, 1] AS f UNION ALL SELECT 1, [1, 0, 1] UNION ALL SELECT 1, [0, 1, 1] UNION ALL SELECT 2, [0, 1, 1]),
a AS (SELECT rank, '[' || array_to_string(list_concat(f, p), ', ') || ']' AS state, CASE WHEN rank = 2 THEN coalesce(r_name, 'Buffer') ELSE 'Buffer' END AS name FROM p CROSS JOIN x LEFT JOIN region ON id = 1 << r_regionkey UNION ALL SELECT 0, '[0, 0, 0, 0, 0, 0, 0, 0]', 'All Off')
SELECT state, arg_max(name, rank) AS name FROM a GROUP BY state"""
)
def state_map_build(spark, d):
    """Each region is a stimulus, whose valve is its key."""
    valve = F.lpad(F.bin(F.expr("shiftleft(1, r_regionkey)")), 5, "0")
    return rg.state_map_frame(spark, 5, table(spark, d, "region").select(valve.alias("pattern"), F.col("r_name").alias("name")))


@query()
def assign_ids(spark, d):
    """Ids for the stimulus names that the parts give, upon a registry of two names."""
    names = {r["code"]: r["name"] for r in _stim(spark, d).groupBy("name").agg(F.min("id").cast("string").alias("code")).orderBy("code").collect()}  # a registry, not rows: as many as there are names
    got, _ = rg.assign_ids(names, {"c1_0": "ECONOMY 5mM", "c2_3": "SMALL 7uM"})
    return spark.createDataFrame(sorted((k, names[k], v) for k, v in got.items()), "code string, name string, id string")


# ---------------------------------------------------------------- manifests

FRAMES = """frames AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'W' ELSE 'w' END || (l_suppkey % 40) || '_' || l_linestatus AS folder, CAST(l_orderkey % 400 AS BIGINT) AS frame_no FROM lineitem)"""


def _frames(spark, d):
    li = table(spark, d, "lineitem")
    s = F.col("l_suppkey")
    return li.select(F.concat(F.when(s % 3 == 0, "W").otherwise("w"), (s % 40).cast("string"), F.lit("_"), F.col("l_linestatus")).alias("folder"), (F.col("l_orderkey") % 400).cast("long").alias("frame_no"))


@query(f"WITH {FRAMES} SELECT folder, frame_no // 4 AS volume FROM frames GROUP BY ALL HAVING count(DISTINCT frame_no) = 4")
def complete_volumes(spark, d):
    return st.complete_volumes(_frames(spark, d), ["folder"], 4)


@query(f"WITH {FRAMES}, f AS (SELECT DISTINCT folder FROM frames UNION ALL SELECT 'empty') SELECT f.folder, coalesce(max(frame_no), -1) AS top FROM f LEFT JOIN frames USING (folder) GROUP BY ALL")
def largest_frame(spark, d):
    f = _frames(spark, d)
    folders = f.select("folder").distinct().unionByName(spark.sql("SELECT 'empty' AS folder"))
    return st.largest_frame(f, folders)


@query(f"WITH {FRAMES} SELECT DISTINCT folder, lower(split_part(folder, '_', 1)) AS worm, CASE WHEN left(folder, 1) = 'W' THEN 'ref' ELSE 'ex' END AS kind FROM frames")
def folder_classify(spark, d):
    return st.classified_folders(_frames(spark, d).select("folder").distinct()).select("folder", "worm", "kind")


@query(
    f"""WITH {FRAMES}, v AS (SELECT DISTINCT folder, frame_no // 20 AS volume FROM frames) SELECT folder, volume FROM v WHERE left(folder, 1) = 'w' OR volume = (SELECT min(volume) FROM v x WHERE x.folder = v.folder)"""
)
def conversion_manifest(spark, d):
    v = _frames(spark, d).select("folder", F.floor(F.col("frame_no") / 20).cast("long").alias("volume")).distinct()
    return st.conversion_manifest(v.select("folder").distinct(), v).select("folder", "volume")


@query(f"WITH {FRAMES}, v AS (SELECT DISTINCT folder, frame_no // 20 AS volume FROM frames) SELECT folder, volume FROM v WHERE volume * 20 <= 130 AND volume * 20 + 19 >= 50")
def range_overlap(spark, d):
    v = _frames(spark, d).select("folder", F.floor(F.col("frame_no") / 20).cast("long").alias("volume")).distinct()
    return st.overlapping(v, 50, 130)


@query(
    f"""WITH {FRAMES}, v AS (SELECT DISTINCT frame_no // 20 AS volume FROM frames), p AS (SELECT volume, CAST(r.p AS INT) AS place, CASE WHEN volume % 2 = 1 THEN 17 - r.p ELSE r.p END AS z FROM v CROSS JOIN range(18) r(p))
SELECT volume, place, volume * 20 + z AS frame_no, printf('%08d.tif', volume * 20 + z) AS file FROM p"""
)
def frame_paths(spark, d):
    v = _frames(spark, d).select(F.floor(F.col("frame_no") / 20).cast("long").alias("volume")).distinct()
    return st.frame_paths(v, reverse_odd=True)


@query("SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END || l_suppkey AS worm, min(l_orderkey) AS first FROM lineitem GROUP BY ALL")
def first_per_prefix(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"))
    one = st.first_of_each(li, ["l_suppkey"], ["l_orderkey"])
    return one.select(F.concat(F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b"), F.col("l_suppkey").cast("string")).alias("worm"), F.col("l_orderkey").alias("first"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 ELSE l_quantity END AS cut, CAST(floor(least(greatest((l_quantity - 5) / 30, 0), 1) * 255) AS INT) AS grey, count(*) AS n FROM lineitem GROUP BY ALL")
def intensity_maps(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity")
    out = li.select("l_orderkey", "l_linenumber", bx.thresholded(q, 10).cast("double").alias("cut"), bx.stretched(q, 5.0, 35.0).alias("grey"))
    return out.groupBy("l_orderkey", "l_linenumber", "cut", "grey").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- boxes

BOXES = """boxes AS (SELECT CAST(o_orderkey % 20 AS BIGINT) AS t, CAST(o_custkey % 30 AS BIGINT) AS neuron, o_totalprice % 50 AS x, o_totalprice % 37 AS y, o_totalprice % 11 AS z, 3.0 AS w, 4.0 AS h, 2.0 AS d FROM orders)"""


def _boxes(spark, d):
    o = table(spark, d, "orders")
    p = F.col("o_totalprice")
    return o.select((F.col("o_orderkey") % 20).cast("long").alias("t"), (F.col("o_custkey") % 30).cast("long").alias("neuron"), (p % 50).alias("x"), (p % 37).alias("y"), (p % 11).alias("z"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h"), F.lit(2.0).alias("d"))


BOUNDS = BOXES + """, bounds AS (SELECT t, neuron, greatest(CAST(trunc(x - 1.5) AS BIGINT), 0) AS x_lo, least(CAST(trunc(x + 1.5) AS BIGINT), 48) AS x_hi, greatest(CAST(trunc(y - 2) AS BIGINT), 0) AS y_lo, least(CAST(trunc(y + 2) AS BIGINT), 36) AS y_hi,
greatest(CAST(ceil(z - 1) AS BIGINT), 0) AS z_lo, least(CAST(ceil(z + 1) AS BIGINT), 10) AS z_hi FROM boxes)"""


@query(f"WITH {BOUNDS} SELECT * FROM bounds")
def box_bounds(spark, d):
    return bx.bounds(_boxes(spark, d), (48, 36, 10))


@query(f"WITH {BOUNDS}, a AS (SELECT *, unnest(range(x_lo, x_hi)) AS x FROM bounds), b AS (SELECT *, unnest(range(y_lo, y_hi)) AS y FROM a), c AS (SELECT *, unnest(range(z_lo, z_hi)) AS z FROM b) SELECT t, x, y, z, max(neuron) AS label FROM c GROUP BY t, x, y, z")
def box_voxels(spark, d):
    return bx.voxels(bx.bounds(_boxes(spark, d), (48, 36, 10)))


@query(
    f"""WITH {BOUNDS}, a AS (SELECT *, unnest(range(x_lo, x_hi)) AS x FROM bounds), b AS (SELECT *, unnest(range(y_lo, y_hi)) AS y FROM a), c AS (SELECT *, unnest(range(z_lo, z_hi)) AS z FROM b),
v AS (SELECT t, x, y, z, max(neuron) AS label FROM c GROUP BY t, x, y, z), m AS (SELECT *, CASE WHEN lag(x) OVER w = x - 1 AND lag(label) OVER w = label THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY t, z, y ORDER BY x)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY t, z, y ORDER BY x) AS g FROM m) SELECT t, z, y, min(x) AS x_from, max(x) + 1 AS x_to, label FROM g GROUP BY t, z, y, g, label"""
)
def box_runs(spark, d):
    """A28 as runs of one label on each line."""
    return bx.label_runs(bx.bounds(_boxes(spark, d), (48, 36, 10)))


GAPS = BOXES + """, means AS (SELECT t, neuron, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(w) AS w FROM boxes GROUP BY t, neuron),
b AS (SELECT * FROM means WHERE (7 * t + 3 * neuron) % 9 <> 0 AND neuron <> 3), g AS (SELECT t, neuron FROM means EXCEPT SELECT t, neuron FROM b)"""


def _gaps(spark, d):
    """Boxes of which every ninth, and one object always, is missing."""
    b = _boxes(spark, d).groupBy("t", "neuron").agg(*[F.avg(c).alias(c) for c in "xyzw"])
    gone = ((7 * F.col("t") + 3 * F.col("neuron")) % 9 == 0) | (F.col("neuron") == 3)
    return b.select("t", "neuron", *[F.when(~gone, F.col(c)).alias(c) for c in "xyzw"])


@query(
    f"""WITH {GAPS}, ref AS (SELECT g.neuron, g.t, b.t AS t_ref FROM g JOIN b USING (neuron) QUALIFY row_number() OVER (PARTITION BY g.neuron, g.t ORDER BY abs(b.t - g.t), b.t) = 1),
near AS (SELECT r.neuron, r.t, q.neuron AS near, q.x, q.y, q.z, row_number() OVER (PARTITION BY r.neuron, r.t ORDER BY sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), q.neuron) AS rank
FROM ref r JOIN b p ON p.t = r.t_ref AND p.neuron = r.neuron JOIN b q ON q.t = r.t_ref AND q.neuron <> r.neuron QUALIFY rank <= 20),
found AS (SELECT n.*, s.x - n.x AS dx, s.y - n.y AS dy, s.z - n.z AS dz, min(rank) OVER (PARTITION BY n.neuron, n.t) AS first FROM near n JOIN b s ON s.t = n.t AND s.neuron = n.near),
moved AS (SELECT neuron, t, avg(dx) AS dx, avg(dy) AS dy, avg(dz) AS dz, count(*) AS n FROM found WHERE rank <= CASE WHEN first <= 5 THEN 5 ELSE 5 + ceil((first - 5) / 5.0) * 5 END GROUP BY ALL)
SELECT g.neuron, g.t, r.t_ref, round(p.x + dx, 6) + 0 AS x, round(p.y + dy, 6) + 0 AS y, round(p.z + dz, 6) + 0 AS z, coalesce(m.n, 0) AS n, CASE WHEN m.n > 0 THEN p.w END AS w
FROM g LEFT JOIN ref r USING (neuron, t) LEFT JOIN b p ON p.t = r.t_ref AND p.neuron = g.neuron LEFT JOIN moved m ON m.neuron = g.neuron AND m.t = g.t"""
)
def imputed_positions(spark, d):
    """Places and sizes of missing objects from the nearest time at which each is seen."""
    out = ob.imputed_positions(_gaps(spark, d), features=("w",))
    return out.select("neuron", "t", "t_ref", *[r6(F.col(c), c) for c in "xyz"], "n", "w")


@query(
    f"""WITH {GAPS} SELECT p.t, p.neuron, q.neuron AS near, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 6) AS dist,
CAST(row_number() OVER (PARTITION BY p.t, p.neuron ORDER BY (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, q.neuron) AS INT) AS rank FROM b p JOIN b q ON p.t = q.t AND p.neuron <> q.neuron QUALIFY rank <= 4"""
)
def nearest_objects(spark, d):
    """The four nearest neighbours of each object in each frame."""
    b = _gaps(spark, d).where("x IS NOT NULL")
    return ob.k_nearest(b, b, ["t"], "neuron", 4).select("t", "neuron", "near", r6(F.col("dist"), "dist"), "rank")


@query(
    """WITH h AS (SELECT n_nationkey AS id, (n_nationkey * 0.6180339887498949::DOUBLE) % 1.0 * 6 AS h FROM nation), s AS (SELECT id, CAST(floor(h) AS INT) AS s, h - floor(h) AS f, 0.92::DOUBLE AS v, 0.92::DOUBLE * (1 - 0.55::DOUBLE) AS p FROM h),
c AS (SELECT id, s, v, p, v * (1 - 0.55::DOUBLE * f) AS q, v * (1 - 0.55::DOUBLE * (1 - f)) AS t FROM s),
g AS (SELECT id, CASE s WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r, CASE s WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END AS g, CASE s WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b FROM c)
SELECT id, printf('#%02x%02x%02x', CAST(floor(r * 255) AS INT), CAST(floor(g * 255) AS INT), CAST(floor(b * 255) AS INT)) AS color FROM g"""
)
def hue_colors(spark, d):
    """Hues by steps of the golden ratio."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), nm.hue_colour(F.col("n_nationkey") * 0.6180339887498949).alias("color"))
