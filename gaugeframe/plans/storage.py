"""Sources, sinks, manifests, resume and repair; files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions.color import EXPECTED_COLORS, PALETTE
from gaugeframe.plans.catalog import query
from gaugeframe.plans.fixtures import FILE_NAMES, file_names, r6, table, with_
from gaugeframe.plans.rules import NAME_RX
from gaugeframe.sources import catalog_scan as CS
from gaugeframe.sources import jsonfiles as J
from gaugeframe.sources import listing as L
from gaugeframe.sources.filetree import list_tree
from gaugeframe.sources import tables as W
from gaugeframe.sources.spec import spec_axes
from gaugeframe.streaming import incremental as INC


@query("select cast(o_orderkey as varchar) as filename, cast(o_custkey as varchar) as unit, o_orderpriority || ', \"x\"' as note from orders")
def a01_read_csv_bom(spark, sf):
    folder = W.scratch_folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias(W.BOM + "filename"), F.col("o_custkey").alias("unit"), F.concat("o_orderpriority", F.lit(', "x"')).alias("note"))
    o.write.option("header", True).option("escape", '"').csv(f"{folder}/csv")
    return W.read_csv_bom(spark, f"{folder}/csv")


@query("""select 'images' as name, count(*) as n from orders union all select 'pairs', count(*) from lineitem union all select 'units', count(*) from customer union all select 'scatter', 0""")
def a02_read_required_tables(spark, sf):
    folder = W.scratch_folder(spark)
    W.write_tables({"images": table(spark, sf, "orders"), "pairs": table(spark, sf, "lineitem"), "units": table(spark, sf, "customer")}, folder)
    got = W.read_required(spark, folder, ["images", "pairs", "units"], {"scatter": "filename string, point_rank int"})
    counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in got.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""select c_custkey as unit_id, 'X' as axis, c_mktsegment as scope, 'READY_' || c_nationkey as status, c_name as canonical from customer
  union all select c_custkey, 'Y', 'EXHAUSTIVE', case when c_acctbal < 0 then 'REVIEW_' else 'READY_' end || c_nationkey, null from customer""")
def a03_read_spec_long(spark, sf):
    wide = table(spark, sf, "customer").selectExpr(
        "c_custkey as unit_id", "c_mktsegment as x_scope", "'EXHAUSTIVE' as y_scope", "concat('READY_', cast(c_nationkey as string)) as x_status",
        "concat(case when c_acctbal < 0 then 'REVIEW_' else 'READY_' end, cast(c_nationkey as string)) as y_status", "c_name as x_canonical",
    )
    return spec_axes(wide, ["unit_id"], ["scope", "status", "canonical"])


LINE = """case when event_type = 'error' then concat('[', cast(event_id as string), ']') when value > 60 then concat('{"unit_id": ', cast(event_id as string)) when value < 0.5 then '   '
  else concat('{"unit_id": "', cast(event_id as string), '", "prompt_text": "', event_type, '"}') end"""


@query(f"""with l as (select event_id, event_type, {LINE} as line, case when event_type = 'error' then 'REJECT' when value > 60 then 'REJECT' when value < 0.5 then 'BLANK' else 'VALID' end as outcome from events)
  select outcome, case when outcome = 'VALID' then event_type end as prompt_text, count(*) as n from l where outcome <> 'BLANK' group by all""")
def a04_read_jsonl_validated(spark, sf):
    folder = W.scratch_folder(spark)
    table(spark, sf, "events").select(F.expr(LINE).alias("value")).write.text(f"{folder}/lines")
    valid, rejects = J.read_jsonl(spark, f"{folder}/lines", "unit_id string, prompt_text string")
    v = valid.groupBy("prompt_text").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("VALID"))
    r = rejects.agg(F.count(F.lit(1)).alias("n")).withColumns({"outcome": F.lit("REJECT"), "prompt_text": F.lit(None).cast("string")})
    return v.unionByName(r)


@query("""select lang as profile, lang || '-' || doc_id as id, source as pergunta, cast(n_chars as varchar) as resposta from documents""")
def a05_explode_profile_json(spark, sf):
    folder = W.scratch_folder(spark)
    d = table(spark, sf, "documents")
    # 64 neighbouring documents share one JSON line, so no group grows with the table
    q = F.struct(F.concat_ws("-", "lang", "doc_id").alias("id"), F.col("source").alias("pergunta"), F.col("n_chars").cast("string").alias("resposta"))
    block = F.floor(F.col("doc_id") / 64).alias("block")
    per = d.groupBy(block, "lang").agg(F.collect_list(q).alias("qs")).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("lang", "qs"))).alias("m"))
    per.select(F.to_json("m").alias("value")).write.text(f"{folder}/json")
    return J.read_profile_json(spark, f"{folder}/json", one_per_line=True).select("profile", "id", "pergunta", "resposta")


# expected colours of the five unit segments
SEGMENT_COLORS = {"AUTOMOBILE": EXPECTED_COLORS["BI"], "BUILDING": EXPECTED_COLORS["BC"], "FURNITURE": EXPECTED_COLORS["LI"], "HOUSEHOLD": EXPECTED_COLORS["LC"], "MACHINERY": EXPECTED_COLORS["SC"]}
_CFG = [(p, i, n, PALETTE[n]) for p, ns in SEGMENT_COLORS.items() for i, n in enumerate(ns)]


@query("select c_custkey as unit_id, profile, idx, color_name, hex from customer join (values " + ", ".join(f"('{p}', {i}, '{n}', '{h}')" for p, i, n, h in _CFG) + ") v(profile, idx, color_name, hex) on c_mktsegment = profile")
def a06_read_color_config(spark, sf):
    """The configuration file is read, checked and attached to every unit."""
    import json

    folder = W.scratch_folder(spark)
    text = json.dumps({"palette_F": PALETTE, "expected_colors_by_profile": SEGMENT_COLORS})
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{folder}/config")
    cfg = J.read_color_config(spark, f"{folder}/config", list(SEGMENT_COLORS))
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("profile"))
    return u.join(cfg, "profile")


@query(with_(FILE_NAMES, select=f"""select 'run/' || filename as path, filename, upper(substr(filename,1,2)) as profile, upper(substr(filename,1,1)) as technique, upper(substr(filename,2,1)) as task, cast(substr(filename,4,3) as integer) as unit_number,
  cast(substr(filename,9,2) as integer) as repeat, upper(substr(filename,1,6)) as unit_id from files where regexp_matches(filename, '{NAME_RX}')"""))
def a07_image_inventory(spark, sf):
    return L.image_inventory(file_names(spark, sf).select(F.concat(F.lit("run/"), "filename").alias("path")))


TREE = "concat('data/exp/', case when user_id % 2 = 0 then 'B-ID' else 'L-ID' end, '/', event_type, '/p', cast(user_id as string), '/', case when value < 40 then 'img' else 'thumb' end, cast(event_id as string), case when value < 10 then '.png' when value < 20 then '.JPEG' else '.txt' end)"


@query(f"select split_part(p, '/', 3) as task, split_part(p, '/', 4) as condition, split_part(p, '/', 5) as participant, split_part(p, '/', 6) as image from (select {TREE} as p from events) where split_part(p, '/', 6) like 'img%' and regexp_matches(p, '(?i)\\.(png|jpg|jpeg)$')")
def a08_experiment_tree_inventory(spark, sf):
    return L.experiment_tree(table(spark, sf, "events").select(F.expr(TREE).alias("path")), 2)


@query("select o_orderkey as filename, o_orderstatus as status, o_totalprice as score from orders")
def a09_write_result_tables(spark, sf):
    folder = W.scratch_folder(spark)
    o = table(spark, sf, "orders").selectExpr("o_orderkey as filename", "o_orderstatus as status", "o_totalprice as score")
    W.write_tables({"images": o, "statuses": o.groupBy("status").count()}, folder)
    return spark.read.parquet(f"{folder}/images")


@query("select distinct o_orderstatus as status, strftime(o_orderdate, '%Y-%m') as month, true as has_files from orders")
def a08_listed_result_tree(spark, sf):
    """Folders of a result that was written by status and month, from the files that tasks find there."""
    folder = W.scratch_folder(spark)
    o = table(spark, sf, "orders").selectExpr("o_orderstatus as status", "date_format(o_orderdate, 'yyyy-MM') as month", "o_orderkey as filename")
    o.repartition("status", "month").write.partitionBy("status", "month").parquet(f"{folder}/by-status")
    part = F.split("path", "/")
    value = lambda i: F.substring_index(F.element_at(part, i), "=", -1)
    found = list_tree(spark, f"{folder}/by-status", pattern=r"\.parquet$")
    t = found.select(value(-3).alias("status"), value(-2).alias("month"), (F.col("size") > 0).alias("has_files"))
    return t.groupBy("status", "month").agg(F.bool_or("has_files").alias("has_files"))


ERR = "case when event_type = 'error' then concat('ValueError: bad reading of ', cast(user_id as string)) when value > 80 then 'TimeoutError' end"


@query(f"select event_id, split_part(e, ':', 1) as error_type, e as error_message from (select event_id, {ERR} as e from events) where e is not null")
def a10_write_error_table(spark, sf):
    good, bad = W.split_errors(table(spark, sf, "events").select("event_id", "event_type", "user_id", "value"), F.expr(ERR))
    folder = W.scratch_folder(spark)
    W.write_tables({"errors": bad.select("event_id", "error_type", "error_message"), "rows": good}, folder)
    return spark.read.parquet(f"{folder}/errors")


@query(f"""with r as (select count(*)::double as images, count(distinct o_custkey)::double as participants, count(distinct o_orderstatus)::double as conditions, avg(o_totalprice) as mean_score from orders)
  select 'images' as metric, images as value from r union all select 'participants', participants from r union all select 'conditions', conditions from r union all select 'mean_score', {r6('mean_score')} from r""")
def a12_run_summary(spark, sf):
    from gaugeframe.functions.numbers import rint_round

    return W.run_summary(table(spark, sf, "orders"), {
        "images": F.count(F.lit(1)), "participants": F.count_distinct("o_custkey"), "conditions": F.count_distinct("o_orderstatus"), "mean_score": rint_round(F.avg("o_totalprice")),
    })


@query("""select 'threshold' as key, '2.0' as value union all select 'version', 'v1' union all select 'content_xor', cast(bit_xor(o_orderkey) as varchar) from orders union all select 'rows', cast(count(*) as varchar) from orders""")
def a13_run_manifest(spark, sf):
    fixed = W.manifest(spark, {"threshold": 2.0, "version": "v1"})
    found = table(spark, sf, "orders").agg(F.bit_xor("o_orderkey").cast("string").alias("content_xor"), F.count(F.lit(1)).cast("string").alias("rows"))
    return fixed.unionByName(found.selectExpr("stack(2, 'content_xor', content_xor, 'rows', rows) as (key, value)"))


CHANGED = "case when n_chars > 2000 then concat(text, ' ') else text end"


@query(f"""select n.doc_id, sha256(n.text) as sha256, case when o.doc_id is null then 'CREATED' when o.t = n.text then 'UNCHANGED' else 'OVERWRITTEN' end as action from documents n left join (select doc_id, {CHANGED} as t from documents where lang <> 'es') o on o.doc_id = n.doc_id""")
def a14_emit_by_hash(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", "text")
    old = table(spark, sf, "documents").where("lang <> 'es'").selectExpr("doc_id", f"{CHANGED} as text")
    out = W.emit_by_hash(new, old, "doc_id", "text", overwrite=True)
    return out


@query("""with e as (select page_id, sha256(html) as h from pages), a as (select page_id, sha256(case when length(url) > 40 then html || '!' else html end) as h from pages where not contains(url, '/fr/'))
  select coalesce(e.page_id, a.page_id) as page_id, case when a.h is null then 'MISSING' when e.h is null then 'UNEXPECTED' when a.h = e.h then 'OK' else 'MISMATCH' end as result from e full join a on e.page_id = a.page_id""")
def a15_hash_manifest_check(spark, sf):
    p = table(spark, sf, "pages")
    expected = p.select("page_id", F.sha2("html", 256).alias("sha256"))
    actual = p.where(~F.col("url").contains("/fr/")).select("page_id", F.sha2(F.when(F.length("url") > 40, F.concat("html", F.lit("!"))).otherwise(F.col("html")), 256).alias("sha256"))
    return W.hash_check(expected, actual, "page_id")


@query("select event_id from events where not (event_type in ('click', 'view'))")
def a16_checkpoint_resume(spark, sf):
    """A first run handles part of the work; the second one sees only the rest."""
    folder = W.scratch_folder(spark)
    todo = table(spark, sf, "events").select("event_id", "event_type", "value")
    first = todo.where("event_type in ('click', 'view')")
    for _ in range(2):  # a repeated batch replaces itself
        INC.append_batch(first.select("event_id", "value"), first.select("event_id"), folder, "first")
    return INC.remaining(todo, spark.read.parquet(f"{folder}/parents"), "event_id").select("event_id")


@query("""with l as (select user_id, arg_max(event_type, event_id) as last_type, max(event_id) as last_seq from events group by user_id),
  e as (select user_id from events where event_type = 'error' and value > 50 except select user_id from events where event_type = 'purchase')
  select l.user_id, last_type, last_seq, e.user_id is not null as open_error, cast(null as bigint) as n_expected, cast(null as bigint) as n_done, cast(null as bigint) as n_failed, cast(null as boolean) as publish from l left join e using (user_id)
  union all select null, null, null, null, x, d, f, x = d and f = 0 from (select (select count(distinct user_id) from events) as x, (select count(*) from l) as d, (select count(*) from e) as f)""")
def a17_checkpoint_finalise(spark, sf):
    """Latest row per key with its open error, and one gate row."""
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    last = INC.last_attempts(log, "user_id", "event_id").selectExpr("user_id", "event_type as last_type", "event_id as last_seq")
    failed = INC.open_errors(log.where("event_type = 'error' and value > 50"), log.where("event_type = 'purchase'"), "user_id")
    flagged = last.join(failed.withColumn("open_error", F.lit(True)), "user_id", "left").na.fill(False, ["open_error"])
    return flagged.unionByName(INC.publication_gate(log.select("user_id").distinct(), last, failed), allowMissingColumns=True)


STORED = "case when o_totalprice > 400000 then null when o_orderstatus = 'P' then 'BI_001' else upper(substr({f}, 1, 6)) end"


@query(with_(FILE_NAMES, f"c as (select o.o_orderkey, f.filename, {STORED.format(f='f.filename')} as unit_id, o.o_orderpriority as note from orders o join files f using (o_orderkey))",
             select="select o_orderkey, case when unit_id is distinct from upper(substr(filename, 1, 6)) then upper(substr(filename, 1, 6)) else unit_id end as unit_id, case when unit_id is distinct from upper(substr(filename, 1, 6)) then null else note end as note from c"))
def a18_repair_merge(spark, sf):
    from gaugeframe.plans.fixtures import FILE_NAME_EXPR

    c = table(spark, sf, "orders").selectExpr("o_orderkey", f"{FILE_NAME_EXPR} as filename", f"{STORED.format(f=FILE_NAME_EXPR)} as unit_id", "o_orderpriority as note")
    derived = F.upper(F.substring("filename", 1, 6))
    bad = INC.needs_repair(c, "unit_id", derived)
    repaired = bad.select("o_orderkey", "filename", derived.alias("unit_id"))
    return INC.merge_repaired(c, repaired, "o_orderkey").select("o_orderkey", "unit_id", "note")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW') order by o_orderkey limit 50")
def a19_partial_run_filters(spark, sf):
    """The limit is the feature: a partial run over chosen profiles."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).orderBy("o_orderkey").limit(50)


_SCAN = {"chart_type_orders": ("orders", "o_orderkey", "o_orderstatus", "o_orderpriority"), "lines": ("lineitem", "l_orderkey", "l_returnflag", "l_linestatus"), "units": ("customer", "c_custkey", "c_mktsegment", "c_name"), "pages_stem": ("pages", "page_id", "page_id % 3", "html")}
STRONG = ["o_orderpriority", "o_orderstatus", "html"]
WORDS = ["URGENT", "SPECIFIED", "TITLE"]


def _scan_sql() -> str:
    cols = {"orders": ["o_orderpriority", "o_orderstatus"], "pages": ["html"]}
    parts = []
    for name, (t, f, p, x) in _SCAN.items():
        hits = cols.get(t, [])
        counts = ", ".join(f"count(*) filter (where regexp_matches(upper({x}), '\\b{w}\\b')) as n_{w.lower()}" for w in WORDS)
        parts.append(f"select '{name}' as name, count(*) as n_rows, count(distinct {f}) as n_unique_filename, (select string_agg(v, '|' order by v) from (select distinct cast({p} as varchar) as v from {t})) as profiles, '{'|'.join(hits)}' as strong_columns, {counts} from {t}")
    tier = lambda c, a: f"case when {c} >= 3000 then {a[0]} when {c} >= 1000 then {a[1]} when {c} >= 500 then {a[2]} else 0 end"
    score = f"case when strong_columns <> '' then 10 + len(string_split(strong_columns, '|')) else 0 end + {tier('n_rows', (12, 8, 5))} + {tier('n_unique_filename', (15, 8, 4))} + case when {' + '.join('n_' + w.lower() for w in WORDS)} > 0 then 5 else 0 end + case when regexp_matches(name, 'chart.?type|techni|classif|multiclass|exclusive|stem') then 3 else 0 end"
    return "select *, cast(" + score + " as integer) as score from (" + " union all ".join(parts) + ")"


@query(_scan_sql())
def a20_dataset_profile_score(spark, sf):
    tables = {}
    for name, (t, f, p, x) in _SCAN.items():
        df = table(spark, sf, t)
        if p not in df.columns:
            df = df.withColumn("__profile", F.expr(p))
            p = "__profile"
        tables[name] = (df, f, p, x)
    return CS.profile_score(tables, STRONG, WORDS)


_KIND_TABLES = ["orders", "lineitem", "customer", "documents", "events", "labels"]
_ROLE = {"o_orderkey": "filename", "l_orderkey": "filename", "doc_id": "filename", "event_id": "filename", "o_orderstatus": "color_status_final", "l_returnflag": "axis", "l_linestatus": "bb_collapsed_status", "quality": "observed_technique", "n_chars": "plot_area_status", "event_type": "mark_present", "value": "classification", "user_id": "technique"}


def _kinds_sql() -> str:
    rows = " union all ".join(f"select '{t}' as name, column_name as c from (describe {t})" for t in _KIND_TABLES)
    role = "case c " + " ".join(f"when '{k}' then '{v}'" for k, v in _ROLE.items()) + " else c end"
    return f"""with h as (select name, list({role}) as cols from ({rows}) group by name)
      select h.name, case when list_contains(cols, 'filename') then concat_ws('|', case when list_contains(cols, 'color_status_final') then 'COLOR_FINAL' end, case when list_contains(cols, 'mark_present') then 'MARK_PRESENCE' end,
        case when list_contains(cols, 'plot_area_status') then 'PLOT_AREA' end, case when list_contains(cols, 'observed_technique') then 'TECHNIQUE' end, case when list_contains(cols, 'bb_collapsed_status') and list_contains(cols, 'axis') then 'TICK_CONTENT' end) else '' end as kinds,
        case when list_contains(cols, 'observed_technique') then 5 else 0 end + case when list_contains(cols, 'technique') and list_contains(cols, 'classification') then 3 else 0 end as search_score, n_rows from h
      join (""" + " union all ".join(f"select '{t}' as name, count(*) as n_rows from {t}" for t in _KIND_TABLES) + ") r on r.name = h.name"


@query(_kinds_sql())
def a21_dataset_kind_tag(spark, sf):
    frames = {t: table(spark, sf, t) for t in _KIND_TABLES}
    heads = [df.agg(F.lit(t).alias("name"), F.array(*[F.lit(_ROLE.get(c, c)) for c in df.columns]).alias("cols"), F.count(F.lit(1)).alias("n_rows")) for t, df in frames.items()]
    h = heads[0]
    for x in heads[1:]:
        h = h.unionByName(x)
    rules = {
        "COLOR_FINAL": CS.has_any("color_status_final"),
        "MARK_PRESENCE": CS.has_any("mark_status", "mark_presence_status", "mark_present", "main_mark_status"),
        "PLOT_AREA": CS.has_any("layout_error_mean_vs_f", "plot_area_status"),
        "TECHNIQUE": CS.has_any("technique_status", "technique_final", "chart_type_final", "observed_technique"),
        "TICK_CONTENT": CS.has_any("bb_collapsed_status") & CS.has_any("axis", "source_family"),
    }
    found = CS.search_score(h, ["observed_technique", "technique_final", "chart_type_final"])
    out = CS.kind_tags(h, rules).join(h.select("name", "n_rows"), "name").join(found, "name", "left")
    return out.na.fill(0, ["search_score"])


@query("select event_type, count(*) as n, cast(round_even(sum(value) * 100, 0) as bigint) as cents from events group by event_type")
def j01_incremental_stream(spark, sf):
    """The events arrive as files; every batch is handed over once and appended."""
    folder = W.scratch_folder(spark)
    src = table(spark, sf, "events")
    src.write.partitionBy("event_type").parquet(f"{folder}/in")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    def processed(batch_id):
        # batch 0 has nothing before it; a batch that is repeated does not count as its own predecessor
        return spark.read.parquet(f"{folder}/out").where(F.col("batch") < batch_id) if batch_id else None

    INC.stream_new_files(spark, f"{folder}/in", src.schema, f"{folder}/offsets", "event_id", sink, processed, files=2).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.rint(F.sum("value") * 100).cast("bigint").alias("cents"))
