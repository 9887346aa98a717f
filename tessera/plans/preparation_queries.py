"""Queries p1_ to p6_ over the commit store, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import changefeed, drift, flatten, hierarchy, ledger, orphans
from tessera.plans.tables import table


def _both(op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: op(table(spark, d, "ot_diffs"), table(spark, d, "ot_revisions"))


def _lifespans(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
    return drift.lifespans(drift.cut(drift.footers(diffs, revisions), "footers"))


def _nested(keep_positions: bool) -> Callable:
    positions = list(flatten.POSITION_FIELDS) if keep_positions else []

    def build(diffs: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
        schema = flatten.commit_schema(["id"], positions)
        return flatten.parsed(diffs, "diff", flatten.diff_keys() | {"feed_seq": F.col("feed_seq")}, schema), flatten.parsed(revisions, "snapshot", flatten.snapshot_keys() | {"feed_seq": F.col("feed_seq")}, schema)

    return build


def _flat(make: Callable, positions: bool) -> Callable:
    """A flat table of both sources; ``feed_seq`` tells the delivered rows of one revision apart."""
    keys = ["tab", "revision_id", "parent_id", "feed_seq"]

    def op(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
        a, b = _nested(positions)(diffs, revisions)
        return make(a, keys).unionByName(make(b, keys))

    return op


def _whole(make: Callable) -> Callable:
    """A flat table of both sources with every field of its records."""

    def op(diffs: DataFrame, revisions: DataFrame) -> DataFrame:
        seq = {"feed_seq": F.col("feed_seq")}
        return make(diffs, "diff", flatten.diff_keys() | seq).unionByName(make(revisions, "snapshot", flatten.snapshot_keys() | seq))

    return op


def _orphans(op: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: op(*(table(spark, d, t) for t in ("ot_diffs", "ot_revisions", "ot_revisions_backup")))


def _descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_counts(hierarchy.parent_links(table(spark, d, "ot_diffs"))).withColumnRenamed("id", "revision_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _both(drift.found_changes),
        "p1_lifespans": _both(_lifespans),
        "p1_spellings": _both(drift.spellings),
        "p1_entries": _both(drift.consistent_entries),
        "p1_chunks": _both(drift.consistent_chunks),
        "p1_positions": _both(drift.consistent_positions),
        "p2_found": lambda spark, d: changefeed.live_chunks(table(spark, d, "ot_diffs")),
        "p3_found": _orphans(orphans.orphan_references),
        "p3_counts": _orphans(orphans.orphan_counts),
        "p4_found": lambda spark, d: ledger.changed_ids(table(spark, d, "ot_revisions"), table(spark, d, "ingest_runs")),
        "p4_live": lambda spark, d: ledger.live_ids(table(spark, d, "ot_revisions"), table(spark, d, "ingest_runs")),
        "p5_found": _both(hierarchy.contradictions),
        "p5_hierarchy": lambda spark, d: hierarchy.hierarchy(hierarchy.parent_links(table(spark, d, "ot_diffs")), with_path=True).withColumnRenamed("id", "revision_id").withColumnRenamed("root", "root_id"),
        "p5_descendants": _descendants,
        "p5_closure": lambda spark, d: hierarchy.descendants(hierarchy.parent_links(table(spark, d, "ot_diffs"))),
        "p6_found": _both(flatten.chunks_found),
        "p6_entries": _both(_flat(flatten.entries_table, True)),
        "p6_entry_fields": _both(_whole(flatten.whole_entries)),
        "p6_positions": _both(_whole(flatten.whole_positions)),
        "p6_chunks": _both(_whole(flatten.whole_chunks)),
        "p6_operations": _both(_flat(flatten.operations_table, False)),
    }


_TEXTS = """
texts AS (
    SELECT 'ot_diffs' AS tab, revision_id, CASE WHEN parent_id > 0 THEN parent_id ELSE 0 END AS parent_id, repo, feed_seq, diff AS t FROM ot_diffs
    UNION ALL SELECT 'ot_revisions', id, 0, repo, feed_seq, snapshot FROM ot_revisions),
opened AS (SELECT * EXCLUDE (t), CASE WHEN json_type(TRY_CAST(t AS JSON)) = 'VARCHAR' THEN json_extract_string(TRY_CAST(t AS JSON), '$') ELSE t END AS t FROM texts WHERE t IS NOT NULL),
lists AS (SELECT * EXCLUDE (t), CASE json_type(TRY_CAST(t AS JSON)) WHEN 'OBJECT' THEN TRY_CAST('[' || t || ']' AS JSON) WHEN 'ARRAY' THEN TRY_CAST(t AS JSON) END AS j FROM opened),
entries AS (
    SELECT * EXCLUDE (j, i), i::INT AS entry_no, json_extract(j, '$[' || i || ']') AS entry
    FROM (SELECT *, unnest(range(json_array_length(j)::BIGINT)) AS i FROM lists WHERE j IS NOT NULL) AS listed),
ops AS (
    SELECT * EXCLUDE (entry, i), i::INT AS op_no, json_extract(entry, '$.ops[' || i || ']') AS op
    FROM (SELECT *, unnest(range(coalesce(json_array_length(entry, '$.ops'), 0)::BIGINT)) AS i FROM entries) AS listed),
aggs AS (
    SELECT * EXCLUDE (op), json_extract(op, '$."' || aggregation || '"') AS agg
    FROM (SELECT *, unnest(json_keys(op)) AS aggregation FROM ops) AS named),
sides AS (SELECT *, unnest(['added', 'removed']) AS action FROM aggs),
chunks AS (
    SELECT * EXCLUDE (agg, i), TRY_CAST(json_extract_string(agg, '$.' || action || '[' || i || '].id') AS BIGINT) AS chunk_id
    FROM (SELECT *, unnest(range(coalesce(json_array_length(agg, '$.' || action), 0)::BIGINT)) AS i FROM sides) AS listed)"""



def _text_of(value: str) -> str:
    """The text of a JSON value, a string without its quotes; NULL for null."""
    return f"CASE json_type({value}) WHEN 'VARCHAR' THEN json_extract_string({value}, '$') WHEN 'NULL' THEN NULL ELSE json({value})::VARCHAR END"


def _record(record: str, columns: tuple, named: tuple) -> str:
    """Fields of a JSON object as texts, and ``rest``: its other fields as an object of texts."""
    own = "".join(f"{_text_of(f"json_extract({record}, '$.{c}')")} AS \"{c}\", " for c in columns)
    value = f"json_extract({record}, '$.\"' || k || '\"')"
    keep = f"lambda k: k NOT IN ({', '.join(repr(n) for n in named)}) AND json_type({value}) <> 'NULL'"
    parts = f"list_transform(list_filter(json_keys({record}), {keep}), lambda k: to_json(k)::VARCHAR || ':' || to_json({_text_of(value)})::VARCHAR)"
    return f"{own}CASE WHEN len({parts}) > 0 THEN '{{' || array_to_string({parts}, ',') || '}}' END AS rest"


_FOOTERS = r"""
src AS (SELECT 'ot_diffs' AS tab, shard, file_no, diff AS t FROM ot_diffs UNION ALL SELECT 'ot_revisions', shard, file_no, snapshot FROM ot_revisions),
outer_json AS (SELECT tab, shard, file_no, TRY_CAST(t AS JSON) AS j FROM src WHERE t IS NOT NULL),
held AS (SELECT tab, shard, file_no, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM outer_json WHERE j IS NOT NULL),
files AS (SELECT tab, shard, file_no, row_number() OVER (PARTITION BY tab, shard ORDER BY file_no) AS no FROM (SELECT DISTINCT tab, shard, file_no FROM held WHERE j IS NOT NULL) AS f),
nodes AS (
    SELECT h.tab, h.shard, h.file_no, n.type,
        regexp_replace(regexp_replace(substr(regexp_replace(n.fullkey, '\[\d+\]', '', 'g'), 3), '^ops\.("[^"]*"|[^.]+)', 'ops.*'), '^ops\.\*\.(added|removed)\.', 'ops.*.chunk.') AS path
    FROM held AS h, json_tree(h.j) AS n WHERE h.j IS NOT NULL AND n.type <> 'NULL' AND n.fullkey <> '$' AND NOT n.fullkey LIKE '%]'),
typed AS (
    SELECT tab, shard, file_no, no, path, array_to_string(list_sort(list(DISTINCT CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BOOLEAN' THEN 'boolean'
        WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'int' END)), '|') AS types
    FROM nodes JOIN files USING (tab, shard, file_no) WHERE path <> 'ops.*' GROUP BY tab, shard, file_no, no, path)"""

_LINKS = """
links AS (SELECT revision_id AS id, CASE WHEN parent_id > 0 THEN parent_id END AS parent FROM ot_diffs),
nodes AS (SELECT id, max(parent) AS parent FROM (SELECT * FROM links UNION ALL SELECT parent, NULL FROM links WHERE parent IS NOT NULL) AS x GROUP BY id),
walk AS (
    SELECT id, id AS at_id, [id] AS way, false AS looped FROM nodes
    UNION ALL SELECT w.id, n.parent, list_append(w.way, n.parent), list_contains(w.way, n.parent)
    FROM walk AS w JOIN nodes AS n ON n.id = w.at_id WHERE n.parent IS NOT NULL AND NOT w.looped),
ends AS (
    SELECT w.*, list_position(way, at_id) - 1 AS first_at FROM walk AS w
    WHERE looped OR NOT EXISTS (SELECT 1 FROM nodes AS n WHERE n.id = w.at_id AND n.parent IS NOT NULL)),
tree AS (
    SELECT id, CASE WHEN looped THEN list_min(way[first_at + 1:]) ELSE at_id END AS root, first_at::BIGINT AS depth,
        CASE WHEN NOT looped THEN 'tree' WHEN first_at = 0 THEN 'cycle' ELSE 'below_cycle' END AS kind, way
    FROM ends)"""

_PAIRS = """
pairs AS (
    SELECT ancestor, id, min(distance) AS distance FROM (SELECT id, unnest(way[2:]) AS ancestor, unnest(range(1, len(way))) AS distance FROM ends) AS steps
    WHERE ancestor <> id GROUP BY ancestor, id)"""

_REFERENCES = """
refs AS (
    SELECT 'parent_id' AS ref_field, revision_id, parent_id AS ref_id, min(file_no) AS first_file, min(arrived_at) AS first_at FROM ot_diffs WHERE parent_id > 0 GROUP BY revision_id, parent_id
    UNION ALL SELECT 'revision_id', revision_id, revision_id, min(file_no), min(arrived_at) FROM ot_diffs WHERE revision_id > 0 GROUP BY revision_id),
parents AS (SELECT id, min(file_no) AS parent_file FROM ot_revisions WHERE id IS NOT NULL GROUP BY id),
saved AS (SELECT DISTINCT id FROM ot_revisions_backup),
judged AS (
    SELECT r.*, strftime(first_at, '%Y-%m') AS period,
        CASE WHEN p.id IS NULL AND s.id IS NOT NULL THEN 'deleted' WHEN p.id IS NULL THEN 'missing' WHEN parent_file > first_file THEN 'late' END AS kind
    FROM refs AS r LEFT JOIN parents AS p ON p.id = r.ref_id LEFT JOIN saved AS s ON s.id = r.ref_id)"""


def oracle_sql() -> dict[str, str]:
    changed = """WITH ok AS (SELECT run_id, last_file, lag(run_id) OVER (ORDER BY run_id) AS before FROM ingest_runs WHERE status = 'ok'),
            cur AS (SELECT o.run_id, o.before, r.* FROM ok AS o JOIN ot_revisions AS r ON r.file_no <= o.last_file
                QUALIFY row_number() OVER (PARTITION BY o.run_id, r.id ORDER BY r.timestamp DESC NULLS LAST, r.feed_seq DESC) = 1)
            SELECT c.run_id, c.id FROM cur AS c LEFT JOIN cur AS p ON p.run_id = c.before AND p.id = c.id
            WHERE p.id IS NULL OR c.epoch IS DISTINCT FROM p.epoch OR c.level IS DISTINCT FROM p.level OR c.type IS DISTINCT FROM p.type
                OR c.created_by IS DISTINCT FROM p.created_by OR (c.snapshot IS NULL) <> (p.snapshot IS NULL)"""
    return {
        "p1_found": rf"""WITH {_FOOTERS},
            steps AS (SELECT f.tab, f.shard, f.file_no, f.no, f.no - 1 AS before FROM files AS f WHERE f.no > 1),
            old AS (SELECT s.tab, s.shard, s.file_no, t.path, t.types FROM steps AS s JOIN typed AS t ON t.tab = s.tab AND t.shard = s.shard AND t.no = s.before),
            new AS (SELECT s.tab, s.shard, s.file_no, t.path, t.types FROM steps AS s JOIN typed AS t ON t.tab = s.tab AND t.shard = s.shard AND t.no = s.no),
            delta AS (SELECT tab, shard, file_no, path, o.types AS gone, n.types AS come, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\.[^.]*$', '') ELSE '' END AS parent
                FROM old AS o FULL JOIN new AS n USING (tab, shard, file_no, path) WHERE o.types IS DISTINCT FROM n.types),
            moves AS (SELECT tab, shard, file_no, parent, max(path) FILTER (come IS NULL) AS from_path, max(path) FILTER (gone IS NULL) AS to_path FROM delta WHERE gone IS NULL OR come IS NULL GROUP BY ALL
                HAVING count(*) FILTER (come IS NULL) = 1 AND count(*) FILTER (gone IS NULL) = 1 AND max(gone) = max(come))
            SELECT d.tab, d.shard, d.file_no, d.path, CASE WHEN gone IS NOT NULL AND come IS NOT NULL THEN 'retyped' WHEN m.from_path IS NOT NULL THEN 'renamed' WHEN come IS NULL THEN 'removed' ELSE 'added' END AS change,
                coalesce(m.to_path, '') AS new_path
            FROM delta AS d LEFT JOIN moves AS m ON m.tab = d.tab AND m.shard = d.shard AND m.file_no = d.file_no AND m.from_path = d.path
            WHERE NOT EXISTS (SELECT 1 FROM moves AS x WHERE x.tab = d.tab AND x.shard = d.shard AND x.file_no = d.file_no AND x.to_path = d.path)""",
        "p1_lifespans": f"""WITH {_FOOTERS},
            spans AS (SELECT tab, shard, path, types, min(no) AS start_no, max(no) AS end_no, min(file_no) AS start_file, max(file_no) AS end_file
                FROM (SELECT *, no - row_number() OVER (PARTITION BY tab, shard, path, types ORDER BY no) AS island FROM typed) AS numbered GROUP BY tab, shard, path, types, island)
            SELECT s.tab, s.shard, path, types, start_no::INT AS start_no, end_no::INT AS end_no, start_file, end_file, f.file_no AS after_file
            FROM spans AS s LEFT JOIN files AS f ON f.tab = s.tab AND f.shard = s.shard AND f.no = s.end_no + 1""",
        "p2_found": f"""WITH {_TEXTS},
            last AS (SELECT repo, aggregation, chunk_id,
                arg_max({{'live': action = 'added', 'revision_id': revision_id}}, {{'a': revision_id, 'b': parent_id, 'c': entry_no, 'd': op_no, 'e': action = 'added'}}) AS s
                FROM chunks WHERE tab = 'ot_diffs' GROUP BY repo, aggregation, chunk_id)
            SELECT repo, aggregation, chunk_id, s.revision_id AS revision_id FROM last WHERE s.live""",
        "p3_found": f"WITH {_REFERENCES} SELECT ref_field, revision_id, ref_id, kind, period FROM judged WHERE kind IS NOT NULL",
        "p3_counts": f"""WITH {_REFERENCES} SELECT ref_field, period, count(*) AS n_refs, count(*) FILTER (kind = 'missing') AS n_missing,
            count(*) FILTER (kind = 'deleted') AS n_deleted, count(*) FILTER (kind = 'late') AS n_late FROM judged GROUP BY ref_field, period""",
        "p4_found": changed,
        "p4_live": changed,
        "p5_found": f"""WITH RECURSIVE {_LINKS}, levels AS (SELECT id, max(level) AS level FROM ot_revisions GROUP BY id)
            SELECT id AS revision_id, root AS root_id, depth, kind FROM tree WHERE kind <> 'tree'
            UNION ALL SELECT t.id, t.root, t.depth, 'level' FROM tree AS t JOIN levels AS a ON a.id = t.id JOIN levels AS b ON b.id = t.root
            WHERE t.kind = 'tree' AND a.level <> b.level + t.depth""",
        "p5_hierarchy": f"""WITH RECURSIVE {_LINKS} SELECT id AS revision_id, root AS root_id, depth, kind,
            array_to_string(list_reverse(way[:depth + 1]), '/') AS path FROM tree""",
        "p5_descendants": f"""WITH RECURSIVE {_LINKS}, {_PAIRS} SELECT ancestor AS revision_id, count(*) AS n_descendants, max(distance) AS height FROM pairs GROUP BY ancestor""",
        "p5_closure": f"WITH RECURSIVE {_LINKS}, {_PAIRS} SELECT ancestor, id, distance FROM pairs",
        "p6_found": f"WITH {_TEXTS} SELECT DISTINCT tab, revision_id, parent_id, entry_no, op_no, aggregation, action, chunk_id FROM chunks",
        "p6_entries": f"""WITH {_TEXTS} SELECT tab, revision_id, parent_id, feed_seq, entry_no, coalesce(json_array_length(entry, '$.positions'), 0)::INT AS n_positions,
            coalesce(json_array_length(entry, '$.ops'), 0)::INT AS n_ops FROM entries""",
        "p6_entry_fields": f"""WITH {_TEXTS} SELECT tab, revision_id, parent_id, feed_seq, entry_no, coalesce(json_array_length(entry, '$.positions'), 0)::INT AS n_positions,
            coalesce(json_array_length(entry, '$.ops'), 0)::INT AS n_ops, {_record("entry", (), ("positions", "ops"))} FROM entries""",
        "p6_positions": f"""WITH {_TEXTS}, listed AS (
                SELECT * EXCLUDE (entry, i), i::INT AS position_no, json_extract(entry, '$.positions[' || i || ']') AS record
                FROM (SELECT *, unnest(range(coalesce(json_array_length(entry, '$.positions'), 0)::BIGINT)) AS i FROM entries) AS numbered)
            SELECT tab, revision_id, parent_id, feed_seq, entry_no, position_no, {_record("record", flatten.POSITION_FIELDS, flatten.POSITION_FIELDS)} FROM listed""",
        "p6_chunks": f"""WITH {_TEXTS}, listed AS (
                SELECT * EXCLUDE (agg, i), i::INT AS chunk_no, json_extract(agg, '$.' || action || '[' || i || ']') AS record
                FROM (SELECT *, unnest(range(coalesce(json_array_length(agg, '$.' || action), 0)::BIGINT)) AS i FROM sides) AS numbered)
            SELECT tab, revision_id, parent_id, feed_seq, entry_no, op_no, aggregation, action, chunk_no, TRY_CAST(json_extract_string(record, '$.id') AS BIGINT) AS chunk_id,
                {_record("record", flatten.CHUNK_FIELDS, flatten.CHUNK_FIELDS)} FROM listed""",
        "p6_operations": f"""WITH {_TEXTS} SELECT tab, revision_id, parent_id, feed_seq, entry_no, op_no, aggregation,
            coalesce(json_array_length(agg, '$.added'), 0)::INT AS n_added, coalesce(json_array_length(agg, '$.removed'), 0)::INT AS n_removed FROM aggs""",
    }
