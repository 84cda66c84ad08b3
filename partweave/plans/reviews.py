"""Queries over patterns, decisions, exports and the state of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.functions import text as t
from partweave.operators import patterns as pt
from partweave.operators import reviews as rv
from partweave.operators import rules as r
from partweave.operators.matching import exact_best, first_by, once, unmatched
from partweave.plans.matchers import SQL as MATCHER_SQL
from partweave.plans.reports import _LINES, _SIGN, _USABLE, SQL as REPORT_SQL, _newest
from partweave.plans.sqltext import sql_canonical, sql_stored
from partweave.sources.tables import table


def _t(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def _patterns(spark: SparkSession, folder: str) -> DataFrame:
    stores, suppliers = _t(spark, folder, "store_items", "supplier_items")
    s = once(stores).select(F.col("id").alias("store_id"), F.col("part_number").alias("a"), F.upper(F.trim("line_code")).alias("line"))
    u = once(suppliers).select(F.col("id").alias("supplier_id"), F.col("part_number").alias("b"))
    return pt.described_patterns(exact_best(stores, suppliers).join(s, "store_id").join(u, "supplier_id").withColumnRenamed("store_id", "id"))


def described_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).select("signature", "n", "change", "rule_type", "line_code")


def pattern_rules(spark: SparkSession, folder: str) -> DataFrame:
    return pt.pattern_rules(_patterns(spark, folder))


def pattern_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return pt.clustered_patterns(_patterns(spark, folder))


def similar_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    stores, suppliers, candidates = _t(spark, folder, "store_items", "supplier_items", "match_candidates")
    return pt.similar_unmatched(unmatched(stores, candidates), suppliers, _patterns(spark, folder))


def _signed(spark: SparkSession, folder: str) -> DataFrame:
    """(id, status, line, a, b) of each candidate whose target is a catalogue row."""
    stores, suppliers, candidates = _t(spark, folder, "store_items", "supplier_items", "match_candidates")
    full = rv.with_targets(r.newest(candidates, "store_item_id", "target_type", "target_id", "status"), stores, suppliers)
    return full.select("id", "status", F.upper(F.trim("store_line_code")).alias("line"), F.col("store_part_number").alias("a"), F.col("supplier_part_number").alias("b"))


def bulk_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    return pt.bulk_suggestions(_signed(spark, folder))


def pattern_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The new versions by which a pattern, the removal of dashes, is applied to pending candidates."""
    signed = _signed(spark, folder).filter(F.col("status") == "PENDING")
    return signed.filter(t.punctuation_signature(F.col("a"), F.col("b")) == "remove_dash").select("id", F.lit("CONFIRMED").alias("status"))


def stage_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of master rules at work: pairs added that no blocking rule forbids, and candidates taken away."""
    four = _t(spark, folder, "store_items", "supplier_items", "master_rules", "match_candidates")
    added = r.positive_candidates(*four).select(F.lit("added").alias("action"), F.concat_ws("|", "store_id", "supplier_id").alias("what"), "rule_id")
    return added.unionByName(r.blocked_candidates(*four).select(F.lit("blocked").alias("action"), F.col("id").alias("what"), "rule_id"))


def flagged_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Interchange candidates with the flag of the first interchange of their two numbers that has one."""
    stores, suppliers, candidates, interchanges = _t(spark, folder, "store_items", "supplier_items", "match_candidates", "interchanges")
    c = r.newest(candidates, "project_id", "store_item_id", "target_type", "target_id", "method").filter(F.upper(F.trim("method")) == "INTERCHANGE")
    full = rv.with_targets(c, stores, suppliers).select("id", "project_id", t.norm_stored(F.col("store_part_number")).alias("ours"), t.norm_stored(F.col("supplier_part_number")).alias("theirs"))
    sides = lambda a, b: once(interchanges).filter("flag_type is not null").select("project_id", F.col("id").alias("edge_id"), "flag_type", "flag_message", t.norm_stored(F.col(a)).alias("ours"), t.norm_stored(F.col(b)).alias("theirs"))
    flags = sides("merrill_part_number", "vendor_part_number").unionByName(sides("vendor_part_number", "merrill_part_number"))
    best = first_by(full.join(flags, ["project_id", "ours", "theirs"]), ["id"], [F.col("edge_id")])
    return best.select("id", "edge_id", "flag_type", "flag_message")


def decision_history(spark: SparkSession, folder: str) -> DataFrame:
    return rv.decision_history(table(spark, folder, "match_candidates"))


def unmatched_projects(spark: SparkSession, folder: str) -> DataFrame:
    return rv.unmatched_projects(table(spark, folder, "match_candidates"))


def review_export_full(spark: SparkSession, folder: str) -> DataFrame:
    return rv.export_rows(*_t(spark, folder, "match_candidates", "store_items", "supplier_items"))


def filtered_export(spark: SparkSession, folder: str) -> DataFrame:
    return rv.filtered_export(review_export_full(spark, folder), status="pending", method="FUZZY")


def review_import(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates' own decisions read back as a reviewer's entries: what each entry says, or why it is refused."""
    c = table(spark, folder, "match_candidates")
    entries = r.newest(c, "status", "corrected_supplier_part_number").select(F.col("id").alias("match_id"), F.lower("status").alias("status"), F.col("corrected_supplier_part_number").alias("corrected_number"))
    entries = entries.select("match_id", F.when(F.col("status") == "confirmed", "accept").when(F.col("status") == "rejected", " Reject ").otherwise("").alias("decision"), "corrected_number")
    return r.check_reviews(entries, c).select(F.col("match_id").alias("id"), "status", "error")


def project_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each project by table, and its matched store rows."""
    count = lambda name, alias: table(spark, folder, name).filter("project_id is not null").groupBy("project_id").agg(F.countDistinct("id").alias(alias))
    c = r.newest(table(spark, folder, "match_candidates"), "project_id", "store_item_id", "status").filter("status <> 'REJECTED'").groupBy("project_id").agg(F.countDistinct("store_item_id").alias("matched"))
    out = count("store_items", "stores")
    for more in (count("supplier_items", "suppliers"), count("interchanges", "interchanges"), c):
        out = out.join(more, "project_id", "full")
    return out.na.fill(0)


def exact_line_stats(spark: SparkSession, folder: str) -> DataFrame:
    from partweave.operators.matching import exact_by_line

    k = F.col("confidence")
    part = lambda test, name: F.count(F.when(test, 1)).alias(name)
    return exact_by_line(*_t(spark, folder, "store_items", "supplier_items")).agg(F.count("*").alias("matches"), part(k >= 1, "perfect"), part((k >= 0.98) & (k < 1), "high"), part((k >= 0.95) & (k < 0.98), "medium"), part(k < 0.95, "low"))


def category_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by the category that their features name; the others count as unknown."""
    c = r.newest(table(spark, folder, "match_candidates"), "features")
    return c.groupBy(F.coalesce(F.get_json_object("features", "$.category"), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


def norm_population(spark: SparkSession, folder: str) -> DataFrame:
    one = lambda name: once(table(spark, folder, name)).groupBy("project_id").agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.count(F.when(F.col("part_number_norm") != "", 1)).alias("with_norm"))
    return one("store_items").unionAll(one("supplier_items"))


def conversion_totals(spark: SparkSession, folder: str) -> DataFrame:
    """How many rules interchanges would make, by the pair of numbers they are taken from, and how many are passed over:
    a number is missing, the rule exists, or an earlier interchange makes it."""
    e, rules = _t(spark, folder, "interchanges", "master_rules")
    known = once(rules).filter("enabled and rule_type = 'POSITIVE_MAP'").select(t.norm_stored(F.col("store_part_number")).alias("a"), t.norm_stored(F.col("supplier_part_number")).alias("b")).distinct().withColumn("known", F.lit(True))
    out = None
    for source, x, y in (("interchange", "merrill_part_number", "vendor_part_number"), ("part_number_interchange", "ours_part_number", "theirs_part_number")):
        rows = once(e).select(t.norm_stored(F.col(x)).alias("a"), t.norm_stored(F.col(y)).alias("b"))
        full = (F.col("a") != "") & (F.col("b") != "")
        made = rows.filter(full).distinct().join(known, ["a", "b"], "left_anti").agg(F.count("*").alias("created"))
        one = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(made)).select(F.lit(source).alias("source"), "created", (F.col("n") - F.col("created")).alias("skipped"))
        out = one if out is None else out.unionAll(one)
    return out


def interchange_matching_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that interchanges give: from whole number to whole number at 1.0, and from number to number without line
    codes at .95 where that differs; each pair once, the surer first."""
    e = once(table(spark, folder, "interchanges")).select(F.trim("vendor_part_number").alias("f"), F.trim("merrill_part_number").alias("g")).filter("f <> '' and g <> ''").distinct()
    bare = lambda c: t.line_code_prefix(F.col(c))["mfr_part"]
    rules = F.array(
        F.struct(F.lit("exact_match").alias("kind"), F.col("f").alias("from"), F.col("g").alias("to"), F.lit(1.0).alias("confidence")),
        F.when(bare("f") != F.col("f"), F.struct(F.lit("part_number_match").alias("kind"), bare("f").alias("from"), bare("g").alias("to"), F.lit(0.95).alias("confidence"))),
    )
    each = e.select(F.explode(F.array_compact(rules)).alias("z")).select("z.*")
    best = each.groupBy("from", "to").agg(F.max(F.struct("confidence", "kind")).alias("z"))
    return best.select("from", "to", "z.kind", "z.confidence")


def _line_maps(spark: SparkSession, folder: str) -> DataFrame:
    """(project_id, code, supplier_code, source): the codes that a project's own rows state, each by its most frequent
    statement, and (project null) the global table's."""
    stores, maps = _t(spark, folder, "store_items", "line_code_mappings")
    own = once(stores).select("project_id", F.upper(F.trim("line_code")).alias("code"), F.upper(F.trim("manufacturer_line_code")).alias("supplier_code")).filter("code <> '' and supplier_code <> ''")
    counted = own.groupBy("project_id", "code", "supplier_code").agg(F.count("*").alias("n"))
    best = first_by(counted, ["project_id", "code"], [F.col("n").desc(), F.col("supplier_code")]).select("project_id", "code", "supplier_code", F.lit("project").alias("source"))
    wide = r.line_code_map(maps).filter("supplier_code is not null").select(F.lit(None).cast("string").alias("project_id"), F.col("client_code").alias("code"), "supplier_code", F.lit("global").alias("source"))
    return best.unionByName(wide)


def mapping_union(spark: SparkSession, folder: str) -> DataFrame:
    return _line_maps(spark, folder)


def preprocessed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each store row's supplier code: the project's mapping before the global one."""
    maps = _line_maps(spark, folder)
    own = maps.filter("source = 'project'").select("project_id", "code", F.col("supplier_code").alias("own"))
    wide = F.broadcast(maps.filter("source = 'global'").select("code", F.col("supplier_code").alias("wide")))
    s = once(table(spark, folder, "store_items")).select("id", "project_id", F.upper(F.trim("line_code")).alias("code"))
    full = s.join(own, ["project_id", "code"], "left").join(wide, "code", "left")
    return full.select("id", F.coalesce("own", "wide").alias("supplier_code"), F.when(F.col("own").isNotNull(), "project").when(F.col("wide").isNotNull(), "global").alias("source"))


def manufacturer_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What filling in missing maker's numbers writes: code and number by the fixed split of the whole number."""
    s = once(table(spark, folder, "store_items")).filter("coalesce(mfr_part_number, '') = '' and part_full is not null")
    split = t.line_code_fixed(F.col("part_full"))
    return s.select("id", split["line_code"].alias("line_code"), split["mfr_part"].alias("mfr_part")).filter("mfr_part is not null")


def norm_backfill(spark: SparkSession, folder: str) -> DataFrame:
    e = once(table(spark, folder, "interchanges"))
    norm = lambda side: F.coalesce(F.nullif(f"{side}_part_number_norm", F.lit("")), t.norm_stored(F.col(f"{side}_part_number"))).alias(f"{side}_norm")
    return e.select("id", norm("merrill"), norm("vendor"))


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each source among open and confirmed candidates in percent, and hours saved at two minutes each."""
    from partweave.plans.reports import source_breakdown

    counts = source_breakdown(spark, folder)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"), F.round(2 * F.col("total") / 60).cast("bigint").alias("hours_saved"))


def activity_page(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of 50 of the log of errors, newest first (pagination is the feature), with the number of all."""
    e = table(spark, folder, "events").filter("event_type = 'error'")
    page = e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(50).limit(50)
    return page.select("event_id", "user_id").crossJoin(F.broadcast(e.agg(F.count("*").alias("total"))))


def match_trace(spark: SparkSession, folder: str) -> DataFrame:
    """What each store row's number meets on its way: interchanges, supplier rows, candidates."""
    stores, suppliers, e, c = _t(spark, folder, "store_items", "supplier_items", "interchanges", "match_candidates")
    s = once(stores).select("project_id", "id", t.norm_stored(F.col("part_number")).alias("norm"))
    both = F.array_distinct(F.array(t.norm_stored(F.col("merrill_part_number")), t.norm_stored(F.col("vendor_part_number"))))
    edges = once(e).select("project_id", F.explode(both).alias("norm")).groupBy("project_id", "norm").agg(F.count("*").alias("edges"))
    bearers = once(suppliers).select("project_id", t.norm_stored(F.col("part_number")).alias("norm")).groupBy("project_id", "norm").agg(F.count("*").alias("bearers"))
    own = r.newest(c, "store_item_id").groupBy(F.col("store_item_id").alias("id")).agg(F.count("*").alias("candidates"))
    full = s.join(edges, ["project_id", "norm"], "left").join(bearers, ["project_id", "norm"], "left").join(own, "id", "left")
    return full.select("id", "norm", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("edges", "bearers", "candidates")])


_NAMES = [described_patterns, pattern_rules, pattern_clusters, similar_unmatched, bulk_suggestions, pattern_applied, stage_zero, flagged_matches, decision_history, unmatched_projects, review_export_full,
          filtered_export, review_import, project_summary, exact_line_stats, category_stats, norm_population, conversion_totals, interchange_matching_rules, mapping_union, preprocessed_lines,
          manufacturer_parts, norm_backfill, dashboard, activity_page, match_trace]
QUERIES = {f.__name__: f for f in _NAMES}


def _change(a: str, b: str, source: str, name: str, keep: str) -> str:
    """CTEs that end in ``name``: ``keep`` of ``source`` with the change from a to b in words."""
    return f"""{name}0 AS (SELECT {keep}, upper(trim({a})) AS x, upper(trim({b})) AS y FROM {source}),
{name}1 AS (SELECT *, [c FOR c, i IN string_split(x, '') IF list_position(string_split(x, ''), c) = i AND NOT contains(y, c)] AS gone, [c FOR c, i IN string_split(y, '') IF list_position(string_split(y, ''), c) = i AND NOT contains(x, c)] AS come FROM {name}0),
{name} AS (SELECT *, CASE WHEN len(gone) = 1 AND len(come) = 1 THEN 'Replace "' || gone[1] || '" with "' || come[1] || '"' WHEN len(gone) > 0 AND len(come) = 0 THEN 'Remove "' || array_to_string(gone, ', ') || '"'
  WHEN len(gone) = 0 AND len(come) > 0 THEN 'Add "' || array_to_string(come, ', ') || '"' WHEN len(gone) + len(come) = 0 AND starts_with(y, x) THEN 'Add suffix "' || substr(y, length(x) + 1) || '"'
  WHEN len(gone) + len(come) = 0 AND ends_with(y, x) THEN 'Add prefix "' || substr(y, 1, length(y) - length(x)) || '"' ELSE 'Transform "' || x || '" → "' || y || '"' END AS change FROM {name}1)"""


_KIND = "CASE WHEN contains(change, 'Replace') OR contains(change, 'Remove') THEN 'punctuation' WHEN contains(change, 'prefix') OR contains(change, 'suffix') THEN 'affix' ELSE 'custom' END"
_MINED = REPORT_SQL["pattern_mining"].rsplit("\nSELECT signature", 1)
_PATTERNS = f"""{_MINED[0]}, mp AS (SELECT signature{_MINED[1]}), {_change('store_number', 'supplier_number', 'b', 'ex', 'store_id')},
dp AS (SELECT mp.*, change, {_KIND} AS rule_type FROM mp JOIN ex ON store_id = example_id)"""
_ITEMS = "si AS (SELECT DISTINCT id AS sid, part_number AS sn, line_code AS sl, description AS sd, current_cost AS sc FROM store_items), ui AS (SELECT DISTINCT id AS uid, part_number AS un, line_code AS ul, description AS ud, current_cost AS uc FROM supplier_items)"
_TARGET = "LEFT JOIN si ON sid = store_item_id LEFT JOIN ui ON uid = target_id AND target_type = 'SUPPLIER' AND NOT starts_with(target_id, 'WEB_')"
_SIGNED = f"{_newest('store_item_id', 'target_type', 'target_id', 'status')}, {_ITEMS}, sg AS (SELECT *, {_SIGN} AS signature FROM (SELECT id, status, upper(trim(sl)) AS line, sn AS a, un AS b FROM c {_TARGET}))"
_EXPORTED = f"WITH {_newest('project_id', 'store_item_id', 'target_type', 'target_id', 'method', 'confidence', 'status', 'vendor_action')}, {_ITEMS}"
_MAPS = f"""{_LINES}, lo AS (SELECT project_id, upper(trim(line_code)) AS code, upper(trim(manufacturer_line_code)) AS supplier_code, count(DISTINCT id) AS n FROM store_items WHERE trim(line_code) <> '' AND trim(manufacturer_line_code) <> '' GROUP BY ALL),
lm AS (SELECT project_id, code, supplier_code, 'project' AS source FROM lo QUALIFY row_number() OVER (PARTITION BY project_id, code ORDER BY n DESC, supplier_code) = 1)"""
_ZERO = {k: REPORT_SQL[k] for k in ("rule_positive", "rule_negative")}

SQL = {
    "described_patterns": f"{_PATTERNS} SELECT signature, n, change, rule_type, line_code FROM dp",
    "pattern_rules": f"{_PATTERNS} SELECT rule_type, signature, change AS transformation, 'global' AS scope, average AS confidence, n AS match_count FROM dp",
    "similar_unmatched": f"""{_PATTERNS}, st AS (SELECT DISTINCT project_id, id AS store_id, upper(trim(line_code)) AS line, upper(trim(part_number)) AS a, {sql_canonical('part_number')} AS key FROM store_items WHERE id NOT IN (SELECT store_item_id FROM match_candidates WHERE store_item_id IS NOT NULL)),
su AS (SELECT DISTINCT project_id, id AS supplier_id, upper(trim(part_number)) AS b, {sql_canonical('part_number')} AS key FROM supplier_items),
mt AS (SELECT store_id, supplier_id, line, a, b, st.key, {_SIGN} AS signature FROM st JOIN su ON su.project_id = st.project_id AND su.key = st.key WHERE st.key <> ''),
mk AS (SELECT mt.*, average, CASE WHEN change LIKE 'Replace%' THEN replace(a, regexp_extract(change, '"(.+)" with "(.+)"', 1), regexp_extract(change, '"(.+)" with "(.+)"', 2))
  WHEN change LIKE 'Remove%' THEN list_reduce(list_prepend(a, string_split(regexp_extract(change, '"(.+)"', 1), ', ')), lambda x, y: replace(x, y, '')) WHEN change LIKE 'Add "%' THEN a || regexp_extract(change, '"(.+)"', 1) END AS made
  FROM mt JOIN dp USING (signature) WHERE line_code IS NULL OR line = line_code)
SELECT store_id, supplier_id, signature, average AS confidence FROM mk WHERE made = b OR made = key OR {sql_stored('made')} = {sql_stored('b')}""",
    "bulk_suggestions": f"""WITH {_SIGNED}, {_change('a', 'b', "(SELECT * FROM sg WHERE signature IS NOT NULL AND status IN ('PENDING', 'CONFIRMED'))", 'ch', 'id, signature, status, line')},
ap AS (SELECT signature, change, line AS of FROM ch WHERE status = 'CONFIRMED' QUALIFY row_number() OVER (PARTITION BY signature ORDER BY id) = 1),
pe AS (SELECT signature, count(*) AS affected, min(line) AS lo, max(line) AS hi, count(line) AS k FROM ch WHERE status = 'PENDING' GROUP BY 1 HAVING count(*) >= 5),
sh AS (SELECT signature, string_agg(id, ' ' ORDER BY id) AS preview FROM (SELECT signature, id FROM ch WHERE status = 'PENDING' QUALIFY row_number() OVER (PARTITION BY signature ORDER BY id) <= 10) GROUP BY 1)
SELECT signature, affected, 'We found ' || affected || ' more items with the same pattern: "' || change || '"' || CASE WHEN lo = hi AND k = affected AND lo = of THEN ' for ' || lo || ' line' ELSE '' END || '. Would you like to approve all of them?' AS message, preview
FROM pe JOIN ap USING (signature) JOIN sh USING (signature)""",
    "pattern_applied": f"WITH {_SIGNED} SELECT id, 'CONFIRMED' AS status FROM sg WHERE status = 'PENDING' AND signature = 'remove_dash'",
    "stage_zero": f"SELECT 'added' AS action, store_id || '|' || supplier_id AS what, rule_id FROM ({_ZERO['rule_positive']}) UNION ALL SELECT 'blocked', id, rule_id FROM ({_ZERO['rule_negative']})",
    "flagged_matches": f"""WITH {_newest('project_id', 'store_item_id', 'target_type', 'target_id', 'method')}, {_ITEMS}, f AS (SELECT c.id, c.project_id, {sql_stored('sn')} AS a, {sql_stored('un')} AS b FROM c {_TARGET} WHERE upper(trim(method)) = 'INTERCHANGE'),
e AS (SELECT DISTINCT project_id, id AS edge_id, flag_type, flag_message, {sql_stored('merrill_part_number')} AS x, {sql_stored('vendor_part_number')} AS y FROM interchanges WHERE flag_type IS NOT NULL)
SELECT f.id, edge_id, flag_type, flag_message FROM f JOIN e ON e.project_id = f.project_id AND ((a = x AND b = y) OR (a = y AND b = x)) QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY edge_id) = 1""",
    "decision_history": """WITH v AS (SELECT id, updated_at, max(status) AS status FROM match_candidates WHERE id IS NOT NULL AND updated_at IS NOT NULL GROUP BY ALL), w AS (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY updated_at) AS before FROM v)
SELECT id, before, status, updated_at FROM w WHERE status IN ('CONFIRMED', 'REJECTED') AND status IS DISTINCT FROM before""",
    "unmatched_projects": f"WITH {_newest('project_id', 'status')} SELECT project_id, count(*) FILTER (NOT coalesce(status = 'CONFIRMED', false)) AS removed, count(*) FILTER (status = 'CONFIRMED') AS kept FROM c GROUP BY ALL",
    "review_export_full": f"""{_EXPORTED} SELECT id AS match_id, project_id, status, method, {_USABLE} AS confidence, sn AS store_part_number, sl AS store_line_code, sd AS store_description, sc AS store_cost, un AS supplier_part_number, ul AS supplier_line_code,
  ud AS supplier_description, uc AS supplier_cost, vendor_action, '' AS review_decision, '' AS corrected_supplier_part FROM c {_TARGET}""",
    "filtered_export": f"""{_EXPORTED} SELECT id AS match_id, project_id, status, method, {_USABLE} AS confidence, sn AS store_part_number, sl AS store_line_code, sd AS store_description, un AS supplier_part_number, ul AS supplier_line_code,
  ud AS supplier_description, vendor_action, '' AS review_decision, '' AS corrected_supplier_part FROM c {_TARGET} WHERE status = 'PENDING' AND method = 'FUZZY'""",
    "review_import": f"""WITH {_newest('status', 'corrected_supplier_part_number')}, p AS (WITH {_newest('project_id')} SELECT id, project_id FROM c),
k AS (SELECT c.id, trim(c.id) = '' AS blank, p.project_id, CASE WHEN status IN ('CONFIRMED', 'REJECTED') THEN status END AS status, coalesce(trim(corrected_supplier_part_number), '') <> '' AS fixed FROM c JOIN p USING (id))
SELECT id, status, CASE WHEN blank THEN 'match_id is missing' WHEN project_id IS NULL THEN 'match_id is unknown' WHEN status IS NULL THEN 'decision cannot be read' WHEN status = 'REJECTED' AND fixed THEN 'a rejected match has a correction' END AS error FROM k""",
    "project_summary": f"""WITH {_newest('project_id', 'store_item_id', 'status')}, n AS (SELECT project_id, 's' AS k, id FROM store_items UNION ALL SELECT project_id, 'u', id FROM supplier_items UNION ALL SELECT project_id, 'e', id FROM interchanges
  UNION ALL SELECT project_id, 'm', store_item_id FROM c WHERE status <> 'REJECTED')
SELECT project_id, count(DISTINCT id) FILTER (k = 's') AS stores, count(DISTINCT id) FILTER (k = 'u') AS suppliers, count(DISTINCT id) FILTER (k = 'e') AS interchanges, count(DISTINCT id) FILTER (k = 'm') AS matched FROM n WHERE project_id IS NOT NULL GROUP BY ALL""",
    "category_stats": f"WITH {_newest('features')} SELECT coalesce(json_extract_string(features, '$.category'), 'unknown') AS category, count(*) AS n FROM c GROUP BY ALL",
    "norm_population": " UNION ALL ".join(f"SELECT project_id, '{x}' AS table_name, count(*) AS n, count(*) FILTER (part_number_norm <> '') AS with_norm FROM (SELECT DISTINCT id, project_id, part_number_norm FROM {x}) GROUP BY ALL" for x in ("store_items", "supplier_items")),
    "conversion_totals": " UNION ALL ".join(
        f"""SELECT '{source}' AS source, k AS created, (SELECT count(DISTINCT id) FROM interchanges) - k AS skipped FROM (SELECT count(*) AS k FROM (SELECT DISTINCT {sql_stored(x)} AS a, {sql_stored(y)} AS b FROM interchanges) WHERE a <> '' AND b <> ''
  AND NOT EXISTS (SELECT 1 FROM master_rules WHERE enabled AND rule_type = 'POSITIVE_MAP' AND {sql_stored('store_part_number')} = a AND {sql_stored('supplier_part_number')} = b))"""
        for source, x, y in (("interchange", "merrill_part_number", "vendor_part_number"), ("part_number_interchange", "ours_part_number", "theirs_part_number"))
    ),
    "interchange_matching_rules": """WITH e AS (SELECT DISTINCT trim(vendor_part_number) AS f, trim(merrill_part_number) AS g FROM interchanges WHERE trim(vendor_part_number) <> '' AND trim(merrill_part_number) <> ''),
h AS (SELECT f, g, """ + ", ".join(f"CASE WHEN length({c}) >= 3 AND length(regexp_replace(upper(substr({c}, 1, 3)), '[^A-Z]', '', 'g')) >= 2 AND length(substr({c}, 4)) >= 2 THEN substr({c}, 4) ELSE {c} END AS {c}b" for c in ("f", "g")) + """ FROM e),
r AS (SELECT f AS "from", g AS "to", 'exact_match' AS kind, 1.0::double AS confidence FROM h UNION ALL SELECT fb, gb, 'part_number_match', 0.95 FROM h WHERE fb <> f)
SELECT DISTINCT * FROM r QUALIFY row_number() OVER (PARTITION BY "from", "to" ORDER BY confidence DESC) = 1""",
    "mapping_union": f"WITH {_MAPS} SELECT * FROM lm UNION ALL SELECT NULL, client_code, supplier_code, 'global' FROM m WHERE supplier_code IS NOT NULL",
    "preprocessed_lines": f"""WITH {_MAPS}, s AS (SELECT DISTINCT id, project_id, upper(trim(line_code)) AS code FROM store_items)
SELECT id, coalesce(lm.supplier_code, m.supplier_code) AS supplier_code, CASE WHEN lm.supplier_code IS NOT NULL THEN 'project' WHEN m.supplier_code IS NOT NULL THEN 'global' END AS source FROM s LEFT JOIN lm ON lm.project_id = s.project_id AND lm.code = s.code LEFT JOIN m ON m.client_code = s.code""",
    "manufacturer_parts": "SELECT DISTINCT id, upper(substr(trim(part_full), 1, 3)) AS line_code, substr(trim(part_full), 4) AS mfr_part FROM store_items WHERE coalesce(mfr_part_number, '') = '' AND length(trim(part_full)) >= 4",
    "norm_backfill": f"SELECT DISTINCT id, coalesce(nullif(merrill_part_number_norm, ''), {sql_stored('merrill_part_number')}) AS merrill_norm, coalesce(nullif(vendor_part_number_norm, ''), {sql_stored('vendor_part_number')}) AS vendor_norm FROM interchanges",
    "dashboard": f"SELECT source, round(100.0 * n / sum(n) OVER (), 2)::double AS percent, round(2 * sum(n) OVER () / 60)::bigint AS hours_saved FROM ({REPORT_SQL['source_breakdown']})",
    "activity_page": "SELECT event_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50",
    "match_trace": f"""WITH {_newest('store_item_id')}, s AS (SELECT DISTINCT project_id, id, {sql_stored('part_number')} AS norm FROM store_items), e AS (SELECT DISTINCT project_id, id, unnest([{sql_stored('merrill_part_number')}, {sql_stored('vendor_part_number')}]) AS norm FROM interchanges),
u AS (SELECT DISTINCT project_id, id, {sql_stored('part_number')} AS norm FROM supplier_items)
SELECT id, norm, (SELECT count(*) FROM e WHERE e.project_id = s.project_id AND e.norm = s.norm) AS edges, (SELECT count(*) FROM u WHERE u.project_id = s.project_id AND u.norm = s.norm) AS bearers, (SELECT count(*) FROM c WHERE store_item_id = s.id) AS candidates FROM s""",
}
SQL["exact_line_stats"] = """SELECT count(*) AS matches, count(*) FILTER (confidence >= 1) AS perfect, count(*) FILTER (confidence >= 0.98 AND confidence < 1) AS high, count(*) FILTER (confidence >= 0.95 AND confidence < 0.98) AS medium, count(*) FILTER (confidence < 0.95) AS low
FROM (""" + MATCHER_SQL["exact_by_line"] + ")"
SQL["pattern_clusters"] = f"""{_PATTERNS}, od AS (SELECT *, regexp_extract_all(lower(change), '"(.+?)"', 1) AS marks, row_number() OVER (ORDER BY n DESC, signature) AS k FROM dp),
rc(k, signature, cluster, heads) AS (SELECT 0, NULL::varchar, NULL::varchar, []::bigint[] UNION ALL
  SELECT od.k, od.signature, coalesce((SELECT h.signature FROM od h WHERE list_contains(rc.heads, h.k) AND h.rule_type = od.rule_type AND (h.line_code IS NULL OR od.line_code IS NULL OR h.line_code = od.line_code) AND list_has_any(h.marks, od.marks) ORDER BY h.k LIMIT 1), od.signature),
    CASE WHEN EXISTS (SELECT 1 FROM od h WHERE list_contains(rc.heads, h.k) AND h.rule_type = od.rule_type AND (h.line_code IS NULL OR od.line_code IS NULL OR h.line_code = od.line_code) AND list_has_any(h.marks, od.marks)) THEN rc.heads ELSE list_append(rc.heads, od.k) END
  FROM rc JOIN od ON od.k = rc.k + 1)
SELECT signature, cluster FROM rc WHERE k > 0"""
