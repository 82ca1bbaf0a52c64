"""Rows that checks of ``lodestream.plans.views`` must give, written out and read against the scripts; by query: columns (with a type where not text) and rows."""

TRUTHS: dict[str, tuple[str, list[tuple]]] = {
    "pm_entities": (
        "script, key, kind, roles, alias_views, n_occurrences:BIGINT, line_start:BIGINT, line_end:BIGINT",
        [
            ('c_join.sql', 'ranked', 'cte', 'cte_fed,read', 'r', 3, 6, 14), ('c_join.sql', 'sales', 'physical', 'cte_fed,write', '', 1, 10, 10), ('c_join.sql', 'stg_customers', 'physical', 'read', 'c', 2, 13, 13),
            ('c_join.sql', 'stg_orders', 'physical', 'read', '', 1, 3, 3), ('c_join.sql', 'totals', 'cte', 'read', 't', 3, 1, 8), ('c_join.sql', '⟐ output@TOP0', 'virtual', 'cte_fed', '', 1, 11, 11),
            ('d_summary.sql', 'kept', 'physical', 'read', 'k', 2, 4, 4), ('d_summary.sql', 'sales', 'physical', 'read', '', 1, 3, 3), ('d_summary.sql', 'summary', 'physical', 'partition,write', '', 2, 1, 6),
            ('d_summary.sql', '⟐ output@TOP0', 'virtual', '', '', 1, 2, 2), ('d_summary.sql', '⟐ output@TOP0/subq0', 'virtual', '', '', 1, 4, 4), ('f_merge.sql', 'sales', 'physical', 'merge_target', 't', 2, 1, 1),
            ('f_merge.sql', 'stg_orders', 'physical', 'read,write', '', 2, 1, 5), ('f_merge.sql', 'u', 'subquery', 'read', '', 1, 1, 1), ('f_merge.sql', '⟐ output@TOP0/subq/u', 'virtual', '', '', 1, 1, 1),
        ],
    ),
    "pm_fields": (
        "key, field, n_occurrences:BIGINT, value_sources:BIGINT, uses",
        [
            ('ranked', 'cust_id', 1, 1, 'DML,JOIN,REF'), ('ranked', 'place', 2, 2, 'DML,REF'), ('ranked', 'total', 1, 1, 'COMPUTED,DML,REF,TRANSFORM'), ('stg_customers', 'cust_id', 2, 1, 'DML,JOIN,REF'),
            ('stg_customers', 'name', 1, 0, 'DML,REF'), ('stg_customers', 'segment', 1, 0, 'DML,REF'), ('stg_orders', 'amount', 1, 0, 'AGGREGATE,REF'), ('stg_orders', 'cust_id', 1, 0, 'REF'),
            ('totals', 'cust_id', 1, 1, 'REF'), ('totals', 'n', 1, 0, ''), ('totals', 'total', 2, 2, 'REF,WINDOW'), ('⟐ output@TOP0', 'band', 1, 1, 'DML'), ('⟐ output@TOP0', 'total', 1, 1, 'DML'),
        ],
    ),
    "pm_edges": (
        "source_key, source_field, target_key, target_field, relationship",
        [
            ('ranked', 'place', 'ranked', 'place', 'REF'), ('ranked', 'total', '⟐ output@TOP0', 'band', 'COMPUTED'), ('ranked', 'total', '⟐ output@TOP0', 'total', 'TRANSFORM'),
            ('stg_customers', 'cust_id', 'stg_customers', 'cust_id', 'REF'), ('stg_orders', 'amount', 'totals', 'total', 'AGGREGATE'), ('stg_orders', 'cust_id', 'totals', 'cust_id', 'REF'),
            ('totals', 'cust_id', 'ranked', 'cust_id', 'REF'), ('totals', 'total', 'ranked', 'place', 'WINDOW'), ('totals', 'total', 'ranked', 'total', 'REF'), ('totals', 'total', 'totals', 'total', 'REF'),
        ],
    ),
    "dg_cases": (
        "script, source, target, relationship, operation",
        [
            ('apart.sql', 'a.x@TOP0', 't@TOP0', 'REF', 'READ'), ('apart.sql', 'b.y@TOP1', 'u@TOP1', 'REF', 'READ'), ('correlated.sql', 'i.oid@TOP0/subq0', 'items@TOP0/subq0', 'REF', 'READ'),
            ('correlated.sql', 'i.v@TOP0/subq0', 'MAX(i.v)@TOP0/subq0', 'AGGREGATE', 'REFERENCE'), ('correlated.sql', 'i.v@TOP0/subq0', 'items@TOP0/subq0', 'REF', 'READ'),
            ('correlated.sql', 'o.id@TOP0', 'heads@TOP0', 'REF', 'READ'), ('correlated.sql', 'o@TOP0', '⟐ output@TOP0/subq0', 'INDIRECT', 'CORRELATED'),
            ('correlated.sql', '⟐ output@TOP0/subq0', 'o.id@TOP0', 'INDIRECT', 'CORRELATED_OUT'), ('correlated.sql', '⟐ output@TOP0/subq0', 'top@TOP0', 'INDIRECT', 'CORRELATED_OUT'),
            ('correlated.sql', '⟐ output@TOP0/subq0', '⟐ output@TOP0', 'TABLE_FLOW', 'SUBSELECT'), ('key.sql', 'a.k@TOP0', "CONCAT(a.k, '-')@TOP0", 'REF', 'REFERENCE'), ('key.sql', 'a.k@TOP0', 't@TOP0', 'REF', 'READ'),
            ('key.sql', 'a.x@TOP0', 't@TOP0', 'REF', 'READ'), ('key.sql', 'b.k@TOP0', "CONCAT(a.k, '-')@TOP0", 'JOIN', 'JOIN_KEY'), ('key.sql', 'b.k@TOP0', 'u@TOP0', 'REF', 'READ'),
            ('key.sql', 'b.y@TOP0', 'u@TOP0', 'REF', 'READ'), ('later.sql', 'm.v@TOP1', 'mid@TOP1', 'REF', 'READ'), ('later.sql', 'm.v@TOP1', 'w@TOP1', 'REF', 'REFERENCE'),
            ('later.sql', 'mid@TOP0', 'm@TOP1', 'DML', 'WRITE_READ'), ('later.sql', 'mid@TOP0', 'mid@TOP1', 'DML', 'WRITE_READ'), ('later.sql', 's.a@TOP0', 'src2@TOP0', 'REF', 'READ'),
            ('later.sql', 's.a@TOP0', 'v@TOP0', 'REF', 'REFERENCE'), ('later.sql', 'v@TOP0', 'm.v@TOP1', 'REF', 'REFERENCE'), ('later.sql', 'v@TOP0', 'src2@TOP0', 'REF', 'READ'),
            ('later.sql', 'w@TOP1', 'mid@TOP1', 'REF', 'READ'), ('picked.sql', 'id@TOP0', 'picked@TOP0', 'REF', 'READ'), ('picked.sql', 'p@TOP0', 'goal@TOP0', 'TABLE_FLOW', 'INSERT'),
            ('picked.sql', 'p@TOP0', '⟐ output@TOP0', 'TABLE_FLOW', 'FROM'), ('picked.sql', 'picked@CTE{picked}', 'goal@TOP0', 'TABLE_FLOW', 'INSERT'),
            ('picked.sql', 'picked@CTE{picked}', '⟐ output@TOP0', 'TABLE_FLOW', 'REFERENCE'), ('picked.sql', 'picked@TOP0', '⟐ output@TOP0', 'TABLE_FLOW', 'REFERENCE'),
            ('picked.sql', 'q.id@CTE{picked}', 'id@TOP0', 'REF', 'REFERENCE'), ('picked.sql', 'q.id@CTE{picked}', 'q@CTE{picked}', 'REF', 'READ'),
            ('picked.sql', 'q@CTE{picked}', 'picked@CTE{picked}', 'TABLE_FLOW', 'FROM'), ('picked.sql', 's.flag@CTE{picked}/subq0', 'src@CTE{picked}/subq0', 'REF', 'READ'),
            ('picked.sql', 's.id@CTE{picked}/subq0', 'src@CTE{picked}/subq0', 'REF', 'READ'), ('picked.sql', 's@CTE{picked}/subq0', '⟐ output@CTE{picked}/subq0', 'TABLE_FLOW', 'FROM'),
            ('picked.sql', '⟐ output@CTE{picked}/subq0', 'picked@CTE{picked}', 'TABLE_FLOW', 'SUBSELECT'),
        ],
    ),
    "dg_bridges": (
        "script, source, target, relationship, operation",
        [
            ('apart.sql', 'w@TOP2', 'w.z@TOP2', 'SUBSET', 'BRIDGE'), ('apart.sql', '⟐ output@TOP0', 'w@TOP2', 'SUBSET', 'BRIDGE'), ('apart.sql', '⟐ output@TOP0', '⟐ output@TOP1', 'SUBSET', 'BRIDGE'),
        ],
    ),
    "dg_honest_bridges": (
        "script, source, target, relationship, operation",
        [
            ('apart.sql', 'w.z@TOP2', 'w@TOP2', 'DML', 'UPDATE'), ('correlated.sql', 'o.id@TOP0/subq0', 'items@TOP0/subq0', 'FILTER', 'CONDITION'), ('star.sql', '*@TOP0', 'stg_customers@TOP0', 'REF', 'READ'),
        ],
    ),
    "l01_field_lineage": (
        "script, name",
        [
            ('d_summary.sql', 'k@TOP0/subq0'), ('d_summary.sql', 'kept@TOP0/subq0'), ('d_summary.sql', 'place@TOP0'), ('d_summary.sql', 'sales@TOP0'), ('d_summary.sql', 'summary@TOP0'),
            ('d_summary.sql', 'summary@TOP1'), ('d_summary.sql', 'worst@TOP0'), ('d_summary.sql', '⟐ output@TOP0'), ('d_summary.sql', '⟐ output@TOP0/subq0'),
        ],
    ),
    "l02_induced": (
        "script, source, target, relationship, operation",
        [
            ('c_join.sql', 'amount@CTE{totals}', 'total@CTE{totals}', 'AGGREGATE', 'REFERENCE'), ('c_join.sql', 'place@CTE{ranked}', 'place@TOP0', 'REF', 'REFERENCE'),
            ('c_join.sql', 'place@TOP0', 'sales@TOP0', 'DML', 'INSERT'), ('c_join.sql', 't.total@CTE{ranked}', 'place@CTE{ranked}', 'WINDOW', 'REFERENCE'),
            ('c_join.sql', 'total@CTE{totals}', 't.total@CTE{ranked}', 'REF', 'REFERENCE'), ('c_join.sql', '⟐ output@TOP0', 'place@TOP0', 'SCHEMA', 'OUTPUT'),
            ('c_join.sql', '⟐ output@TOP0', 'sales@TOP0', 'DML', 'INSERT'),
        ],
    ),
    "l03_relevant": (
        "script, by, n:BIGINT",
        [
            ('c_join.sql', 'all', 27), ('d_summary.sql', 'lineage', 8), ('l_broken.sql', 'all', 3),
        ],
    ),
    "l04_gated_downstream": (
        "script, name",
        [
            ('c_join.sql', 'amount@CTE{totals}'), ('c_join.sql', 'band@TOP0'), ('c_join.sql', 'place@CTE{ranked}'), ('c_join.sql', 'place@TOP0'), ('c_join.sql', 'r.total@TOP0'), ('c_join.sql', 'r@TOP0'),
            ('c_join.sql', 'ranked@CTE{ranked}'), ('c_join.sql', 'ranked@TOP0'), ('c_join.sql', 'sales@TOP0'), ('c_join.sql', 'stg_orders@CTE{totals}'), ('c_join.sql', 't.total@CTE{ranked}'),
            ('c_join.sql', 't@CTE{ranked}'), ('c_join.sql', 'total@CTE{totals}'), ('c_join.sql', 'total@TOP0'), ('c_join.sql', 'totals@CTE{ranked}'), ('c_join.sql', 'totals@CTE{totals}'),
            ('f_merge.sql', 'amount@TOP0/subq/u'), ('f_merge.sql', 'sales.total@TOP0'), ('f_merge.sql', 'sales@TOP0'), ('f_merge.sql', 'stg_orders@TOP0/subq/u'), ('f_merge.sql', 'u.amount@TOP0'),
            ('f_merge.sql', 'u@TOP0'), ('f_merge.sql', '⟐ output@TOP0/subq/u'), ('h_hive.sql', 'open_orders@TOP0/hive_arm0'), ('h_hive.sql', 's.amount@TOP0/hive_arm0'), ('h_hive.sql', 's@TOP0/hive_arm0'),
            ('h_hive.sql', 'stg_orders@TOP0/hive_arm0'), ('h_hive.sql', '⟐ output@TOP0/hive_arm0'), ('j_ambiguous.sql', 'amount@TOP0'), ('j_ambiguous.sql', 'stg_orders@TOP0'), ('j_ambiguous.sql', '⟐ output@TOP0'),
            ('k_window.sql', 'k@TOP0'), ('k_window.sql', 'o.amount@TOP0'), ('k_window.sql', 'o.cust_id@TOP0'), ('k_window.sql', 'o.day@TOP0'), ('k_window.sql', 'o@TOP0'), ('k_window.sql', 'step@TOP0'),
            ('k_window.sql', 'stg_orders@TOP0'), ('k_window.sql', '⟐ output@TOP0'),
        ],
    ),
    "l04_later_reads": (
        "script, name",
        [
            ('later.sql', 'fin@TOP1'), ('later.sql', 'm.v@TOP1'), ('later.sql', 'm@TOP1'), ('later.sql', 'mid@TOP0'), ('later.sql', 'mid@TOP1'), ('later.sql', 's.a@TOP0'), ('later.sql', 's@TOP0'),
            ('later.sql', 'src2@TOP0'), ('later.sql', 'v@TOP0'), ('later.sql', 'w@TOP1'), ('later.sql', '⟐ output@TOP0'), ('later.sql', '⟐ output@TOP1'),
        ],
    ),
    "l05_gated_upstream": (
        "script, name",
        [
            ('c_join.sql', 'amount@CTE{totals}'), ('c_join.sql', 'r.total@TOP0'), ('c_join.sql', 'sales@TOP0'), ('c_join.sql', 't.total@CTE{ranked}'), ('c_join.sql', 'total@CTE{totals}'), ('c_join.sql', 'total@TOP0'),
            ('c_join.sql', '⟐ output@TOP0'), ('f_merge.sql', 'amount@TOP0/subq/u'), ('f_merge.sql', 'sales.total@TOP0'), ('f_merge.sql', 'sales@TOP0'), ('f_merge.sql', 'u.amount@TOP0'),
        ],
    ),
    "l06_row_flow": (
        "source_id, target_id, relationship, operation",
        [
            ('inner', 'outer', 'ROW_FLOW', 'ROW_SELECTION'),
        ],
    ),
    "l07_field_view": (
        "script, source, target, relationship, operation",
        [
            ('c_join.sql', 'amount@CTE{totals}', 'stg_orders@CTE{totals}', 'REF', 'READ'), ('c_join.sql', 'amount@CTE{totals}', 'total@CTE{totals}', 'AGGREGATE', 'REFERENCE'),
            ('c_join.sql', 'band@TOP0', 'sales@TOP0', 'DML', 'INSERT'), ('c_join.sql', 'place@CTE{ranked}', 'place@TOP0', 'REF', 'REFERENCE'), ('c_join.sql', 'place@TOP0', 'ranked@TOP0', 'REF', 'READ'),
            ('c_join.sql', 'place@TOP0', 'sales@TOP0', 'DML', 'INSERT'), ('c_join.sql', 'r.total@TOP0', 'band@TOP0', 'COMPUTED', 'REFERENCE'), ('c_join.sql', 'r.total@TOP0', 'ranked@TOP0', 'REF', 'READ'),
            ('c_join.sql', 'r.total@TOP0', 'sales@TOP0', 'DML', 'INSERT'), ('c_join.sql', 'r.total@TOP0', 'total@TOP0', 'TRANSFORM', 'REFERENCE'), ('c_join.sql', 'r@TOP0', 'r.total@TOP0', 'SCHEMA', 'TABLE_COLUMN'),
            ('c_join.sql', 'r@TOP0', 'sales@TOP0', 'TABLE_FLOW', 'INSERT'), ('c_join.sql', 'ranked@CTE{ranked}', 'sales@TOP0', 'TABLE_FLOW', 'INSERT'), ('c_join.sql', 'ranked@TOP0', 'r@TOP0', 'ALIAS', 'ALIAS'),
            ('c_join.sql', 'stg_orders@CTE{totals}', 'totals@CTE{totals}', 'TABLE_FLOW', 'FROM'), ('c_join.sql', 't.total@CTE{ranked}', 'place@CTE{ranked}', 'WINDOW', 'REFERENCE'),
            ('c_join.sql', 't.total@CTE{ranked}', 'r.total@TOP0', 'REF', 'REFERENCE'), ('c_join.sql', 't.total@CTE{ranked}', 'totals@CTE{ranked}', 'REF', 'READ'),
            ('c_join.sql', 't@CTE{ranked}', 'ranked@CTE{ranked}', 'TABLE_FLOW', 'FROM'), ('c_join.sql', 't@CTE{ranked}', 't.total@CTE{ranked}', 'SCHEMA', 'TABLE_COLUMN'),
            ('c_join.sql', 'total@CTE{totals}', 't.total@CTE{ranked}', 'REF', 'REFERENCE'), ('c_join.sql', 'total@TOP0', 'sales@TOP0', 'DML', 'INSERT'),
            ('c_join.sql', 'totals@CTE{ranked}', 'ranked@CTE{ranked}', 'TABLE_FLOW', 'REFERENCE'), ('c_join.sql', 'totals@CTE{ranked}', 't@CTE{ranked}', 'ALIAS', 'ALIAS'),
            ('c_join.sql', 'totals@CTE{totals}', 'ranked@CTE{ranked}', 'TABLE_FLOW', 'REFERENCE'),
        ],
    ),
    "l09_flow_targets": (
        "script, name",
        [
            ('later.sql', 'fin@TOP1'), ('later.sql', 'mid@TOP0'),
        ],
    ),
    "l10_flow_source": (
        "script, context, line:BIGINT",
        [
            ('a_load.sql', 'TOP0', 2), ('c_join.sql', 'CTE{totals}', 3), ('f_merge.sql', 'TOP0/subq/u', 1), ('h_hive.sql', 'TOP0/hive_arm0', 2), ('j_ambiguous.sql', 'TOP0', 2), ('k_window.sql', 'TOP0', 3),
        ],
    ),
    "l11_io_paths": (
        "path",
        [
            ('amount@CTE{totals}>total@CTE{totals}',), ('amount@CTE{totals}>total@CTE{totals}>t.total@CTE{ranked}>r.total@TOP0>band@TOP0',),
            ('amount@CTE{totals}>total@CTE{totals}>t.total@CTE{ranked}>r.total@TOP0>total@TOP0',), ('place@TOP0>worst@TOP0',), ('r.total@TOP0>band@TOP0',), ('r.total@TOP0>total@TOP0',),
            ('t.total@CTE{ranked}>r.total@TOP0>band@TOP0',), ('t.total@CTE{ranked}>r.total@TOP0>total@TOP0',),
        ],
    ),
    "l12_io_nodes": (
        "name, n_paths:BIGINT, place",
        [
            ('amount@CTE{totals}', 3, 'input'), ('band@TOP0', 3, 'output'), ('place@TOP0', 1, 'input'), ('r.total@TOP0', 6, 'input'), ('t.total@CTE{ranked}', 4, 'input'), ('total@CTE{totals}', 3, 'output'),
            ('total@TOP0', 3, 'output'), ('worst@TOP0', 1, 'output'),
        ],
    ),
    "l12_io_edges": (
        "source, target, n_paths:BIGINT",
        [
            ('amount@CTE{totals}', 'total@CTE{totals}', 3), ('place@TOP0', 'worst@TOP0', 1), ('r.total@TOP0', 'band@TOP0', 3), ('r.total@TOP0', 'total@TOP0', 3), ('t.total@CTE{ranked}', 'r.total@TOP0', 4),
            ('total@CTE{totals}', 't.total@CTE{ranked}', 2),
        ],
    ),
    "l13_variable_search": (
        "script, name, context",
        [
            ('a_load.sql', 'o.o_totalprice', 'TOP0'), ('c_join.sql', 'r.total', 'TOP0'), ('c_join.sql', 't.total', 'CTE{ranked}'), ('d_summary.sql', 'total', 'TOP0'), ('e_report.sql', 'q.total', 'TOP0/exists1'),
            ('e_report.sql', 's.mean_total', 'TOP0'), ('e_report.sql', 'x.mean_total', 'TOP0/subq0'),
        ],
    ),
    "l14_neighbours": (
        "side, name, relationship",
        [
            ('downstream', 't.total@CTE{ranked}', 'REF'), ('upstream', 'amount@CTE{totals}', 'AGGREGATE'), ('upstream', 'totals@CTE{totals}', 'SCHEMA'),
        ],
    ),
    "l15_flow_cone": (
        "side, name",
        [
            ('ahead', 'place@CTE{ranked}'), ('ahead', 'place@TOP0'), ('ahead', 'ranked@TOP0'), ('ahead', 'sales@TOP0'), ('ahead', '⟐ output@TOP0'), ('behind', 'amount@CTE{totals}'), ('behind', 't.total@CTE{ranked}'),
            ('behind', 'total@CTE{totals}'),
        ],
    ),
    "g04_upstream_scripts": (
        "source, target, role",
        [
            ('c_join.sql', '', 'script'), ('c_join.sql', 'sales', 'writes_to'), ('f_merge.sql', '', 'script'), ('f_merge.sql', 'sales', 'writes_to'), ('f_merge.sql', 'stg_orders', 'writes_to'), ('sales', '', 'table'),
            ('stg_orders', '', 'table'), ('stg_orders', 'c_join.sql', 'reads_from'), ('stg_orders', 'f_merge.sql', 'reads_from'),
        ],
    ),
    "g04_downstream_scripts": (
        "source, target, role",
        [
            ('d_summary.sql', '', 'script'), ('d_summary.sql', 'summary', 'writes_to'), ('e_report.sql', '', 'script'), ('f_merge.sql', '', 'script'), ('f_merge.sql', 'sales', 'writes_to'),
            ('f_merge.sql', 'stg_orders', 'writes_to'), ('sales', '', 'table'), ('sales', 'd_summary.sql', 'reads_from'), ('sales', 'e_report.sql', 'reads_from'), ('stg_orders', '', 'table'),
            ('stg_orders', 'f_merge.sql', 'reads_from'), ('summary', '', 'table'), ('summary', 'e_report.sql', 'reads_from'),
        ],
    ),
    "g05_pipeline_nodes": (
        "node, kind, parent, part",
        [
            ('c_join.sql', 'script', '', ''), ('d_summary.sql', 'script', '', ''), ('e_report.sql#⟐ result', 'result', 'e_report.sql', 'output'), ('e_report.sql', 'script', '', ''), ('kept', 'table', '', 'source'),
            ('kept.cust_id', 'field', 'kept', 'indirect'), ('kept.ok', 'field', 'kept', 'indirect'), ('sales', 'table', '', 'intermediate'), ('sales.band', 'field', 'sales', 'direct'),
            ('sales.cust_id', 'field', 'sales', 'indirect'), ('sales.name', 'field', 'sales', 'indirect'), ('sales.place', 'field', 'sales', 'direct'), ('sales.segment', 'field', 'sales', 'indirect'),
            ('sales.total', 'field', 'sales', 'direct'), ('stg_customers', 'table', '', 'source'), ('stg_customers.cust_id', 'field', 'stg_customers', 'indirect'),
            ('stg_customers.name', 'field', 'stg_customers', 'indirect'), ('stg_customers.segment', 'field', 'stg_customers', 'indirect'), ('stg_orders', 'table', '', 'source'),
            ('stg_orders.amount', 'field', 'stg_orders', 'direct'), ('stg_orders.cust_id', 'field', 'stg_orders', 'direct'), ('summary', 'table', '', 'intermediate'),
            ('summary.day_part', 'field', 'summary', 'indirect'), ('summary.mean_total', 'field', 'summary', 'direct'), ('summary.segment', 'field', 'summary', 'indirect'),
            ('summary.worst', 'field', 'summary', 'direct'),
        ],
    ),
    "g05_pipeline_edges": (
        "source, target, role, roles",
        [
            ('c_join.sql', 'sales', 'writes_to', ''), ('d_summary.sql', 'summary', 'writes_to', 'UPDATE SET,WHERE'), ('e_report.sql', 'e_report.sql#⟐ result', 'writes_to', ''),
            ('kept', 'd_summary.sql', 'reads_from', 'SELECT,WHERE'), ('sales', 'd_summary.sql', 'reads_from', 'GROUP BY,SELECT,WHERE'), ('sales', 'e_report.sql', 'reads_from', 'WHERE'),
            ('stg_customers', 'c_join.sql', 'reads_from', 'JOIN ON,SELECT'), ('stg_orders', 'c_join.sql', 'reads_from', 'GROUP BY,SELECT'), ('summary', 'e_report.sql', 'reads_from', 'ORDER BY,SELECT,WHERE'),
        ],
    ),
    "g06_layers": (
        "node, layer:BIGINT",
        [
            ('a_load.sql', 1), ('b_customers.sql', 1), ('blocked', 0), ('c_join.sql', 10), ('d_summary.sql', 10), ('done_orders', 10), ('e_report.sql', 10), ('f_merge.sql', 10), ('g_union.sql', 10), ('h_hive.sql', 10),
            ('i_tables.ddl', 0), ('j_ambiguous.sql', 10), ('k_window.sql', 10), ('kept', 1), ('l_broken.sql', 0), ('logs', 1), ('open_orders', 10), ('people', 10), ('people_view', 10), ('raw.customer', 0),
            ('raw.nation', 0), ('raw.orders', 0), ('raw.supplier', 0), ('sales', 10), ('stg_customers', 2), ('stg_orders', 10), ('summary', 10),
        ],
    ),
    "g06_smooth_layers": (
        "node, layer:BIGINT",
        [
            ('a_load.sql', 9), ('b_customers.sql', 8), ('blocked', 7), ('c_join.sql', 10), ('d_summary.sql', 10), ('done_orders', 10), ('e_report.sql', 10), ('f_merge.sql', 10), ('g_union.sql', 10), ('h_hive.sql', 10),
            ('i_tables.ddl', 9), ('j_ambiguous.sql', 10), ('k_window.sql', 10), ('kept', 9), ('l_broken.sql', 0), ('logs', 1), ('open_orders', 10), ('people', 10), ('people_view', 10), ('raw.customer', 7),
            ('raw.nation', 7), ('raw.orders', 8), ('raw.supplier', 9), ('sales', 10), ('stg_customers', 9), ('stg_orders', 10), ('summary', 10),
        ],
    ),
    "g08_search": (
        "asked, direction, mode, scripts, flow_scripts",
        [
            ('kept.', 'upstream', 'expanded', 'a_load.sql,b_customers.sql,c_join.sql,d_summary.sql,e_report.sql,f_merge.sql,g_union.sql,h_hive.sql,i_tables.ddl,j_ambiguous.sql,k_window.sql', ''),
            ('logs.', 'upstream', 'exact', 'l_broken.sql', ''), ('nowhere.', 'upstream', 'no_matches', '', ''), ('stg_customers.nation', 'downstream', 'no_flow', 'b_customers.sql,i_tables.ddl', ''),
            ('stg_orders.amount', 'downstream', 'exact', 'a_load.sql,c_join.sql,f_merge.sql,h_hive.sql,i_tables.ddl,j_ambiguous.sql,k_window.sql', 'c_join.sql,f_merge.sql,h_hive.sql,j_ambiguous.sql,k_window.sql'),
            ('stg_orders.amount', 'upstream', 'exact', 'a_load.sql,c_join.sql,f_merge.sql,h_hive.sql,i_tables.ddl,j_ambiguous.sql,k_window.sql', 'a_load.sql'), ('stg_orders.nothing', 'upstream', 'no_matches', '', ''),
        ],
    ),
    "g09_lineage_filter": (
        "source, target, role",
        [
            ('c_join.sql', '', 'script'), ('c_join.sql', 'sales', 'writes_to'), ('d_summary.sql', '', 'script'), ('d_summary.sql', 'summary', 'writes_to'), ('e_report.sql#⟐ result', '', 'result'),
            ('e_report.sql', '', 'script'), ('e_report.sql', 'e_report.sql#⟐ result', 'writes_to'), ('sales', '', 'table'), ('sales', 'd_summary.sql', 'reads_from'), ('sales', 'e_report.sql', 'reads_from'),
            ('sales.band', '', 'field'), ('sales.place', '', 'field'), ('sales.total', '', 'field'), ('stg_orders', '', 'table'), ('stg_orders', 'c_join.sql', 'reads_from'), ('stg_orders.amount', '', 'field'),
            ('stg_orders.cust_id', '', 'field'), ('summary', '', 'table'), ('summary', 'e_report.sql', 'reads_from'), ('summary.mean_total', '', 'field'), ('summary.worst', '', 'field'),
        ],
    ),
    "g10_zoom_nodes": (
        "label, node_type, under, part, role",
        [
            ('amount', 'field', 'stg_orders', 'direct', 'waypoint'), ('band', 'field', 'output', 'direct', 'waypoint'), ('output', 'output_table', '', 'indirect', 'waypoint'),
            ('place', 'field', 'ranked', 'direct', 'waypoint'), ('r@14', 'alias_table', 'ranked', 'direct', 'waypoint'), ('ranked', 'cte_table', '', 'direct', 'waypoint'),
            ('sales', 'source_table', '', 'direct', 'target'), ('stg_orders', 'source_table', '', 'direct', 'source'), ('t@8', 'alias_table', 'totals', 'direct', 'waypoint'),
            ('total', 'field', 'output', 'direct', 'waypoint'), ('total', 'field', 'ranked', 'direct', 'waypoint'), ('total', 'field', 'totals', 'direct', 'waypoint'), ('totals', 'cte_table', '', 'direct', 'waypoint'),
        ],
    ),
    "g11_direct_part": (
        "name, part",
        [
            ('amount@CTE{totals}', 'direct'), ('band@TOP0', 'direct'), ('place@CTE{ranked}', 'direct'), ('place@TOP0', 'direct'), ('r.total@TOP0', 'direct'), ('r@TOP0', 'direct'), ('ranked@CTE{ranked}', 'direct'),
            ('ranked@TOP0', 'direct'), ('sales@TOP0', 'direct'), ('stg_orders@CTE{totals}', 'direct'), ('t.total@CTE{ranked}', 'direct'), ('t@CTE{ranked}', 'direct'), ('total@CTE{totals}', 'direct'),
            ('total@TOP0', 'direct'), ('totals@CTE{ranked}', 'direct'), ('totals@CTE{totals}', 'direct'),
        ],
    ),
    "g12_compound": (
        "label, node_type, under, n:BIGINT",
        [
            ('band', 'field', 'sales', 1), ('cust_id', 'field', 'kept', 1), ('cust_id', 'field', 'sales', 1), ('day_part', 'field', 'summary', 1), ('k@4', 'alias_table', 'kept', 1), ('kept', 'source_table', '', 1),
            ('mean_total', 'field', 'output', 1), ('mean_total', 'field', 'summary', 1), ('ok', 'field', 'kept', 1), ('output', 'output_table', '', 1), ('place', 'field', 'sales', 1), ('sales', 'source_table', '', 1),
            ('segment', 'field', 'sales', 1), ('segment', 'field', 'summary', 1), ('summary', 'source_table', '', 2), ('total', 'field', 'sales', 1), ('worst', 'field', 'output', 1),
        ],
    ),
    "g13_trunk": (
        "script, source, target, operation, origin",
        [
            ('c_join.sql', 'band@TOP0', '⟐ output@TOP0', 'INSERT', 'in'), ('c_join.sql', 'place@TOP0', '⟐ output@TOP0', 'INSERT', 'in'), ('c_join.sql', 'r.total@TOP0', '⟐ output@TOP0', 'INSERT', 'in'),
            ('c_join.sql', 'total@TOP0', '⟐ output@TOP0', 'INSERT', 'in'), ('c_join.sql', '⟐ output@TOP0', 'sales@TOP0', 'INSERT', 'out'),
            ('h_hive.sql', 's.amount@TOP0/hive_arm0', '⟐ output@TOP0/hive_arm0', 'INSERT', 'value'), ('h_hive.sql', '⟐ output@TOP0/hive_arm0', 'open_orders@TOP0/hive_arm0', 'INSERT', 'out'),
        ],
    ),
    "g14_combined_edges": (
        "from_, to_, relationship, labels, operations",
        [
            ('amount', 'stg_orders', 'REF', 'REF', 'READ'), ('amount', 'totals', 'AGGREGATE', 'AGGREGATE', 'REFERENCE'), ('output', 'sales', 'TABLE_FLOW', 'out', 'INSERT'),
            ('r@14', 'sales', 'TABLE_FLOW', 'TABLE_FLOW', 'INSERT'), ('r@14', 'total', 'SCHEMA', 'SCHEMA', 'TABLE_COLUMN'), ('ranked', 'output', 'COMPUTED', 'COMPUTED', 'REFERENCE'),
            ('ranked', 'output', 'TABLE_FLOW', 'in', 'INSERT'), ('ranked', 'output', 'TRANSFORM', 'TRANSFORM', 'REFERENCE'), ('ranked', 'r@14', 'ALIAS', 'ALIAS', 'ALIAS'),
            ('ranked', 'sales', 'TABLE_FLOW', 'TABLE_FLOW', 'INSERT'), ('stg_orders', 'totals', 'TABLE_FLOW', 'TABLE_FLOW', 'FROM'), ('t@8', 'ranked', 'TABLE_FLOW', 'TABLE_FLOW', 'FROM'),
            ('t@8', 'total', 'SCHEMA', 'SCHEMA', 'TABLE_COLUMN'), ('totals', 'ranked', 'REF', 'REF', 'REFERENCE'), ('totals', 'ranked', 'TABLE_FLOW', 'TABLE_FLOW', 'REFERENCE'),
            ('totals', 'ranked', 'WINDOW', 'WINDOW', 'REFERENCE'), ('totals', 't@8', 'ALIAS', 'ALIAS', 'ALIAS'),
        ],
    ),
    "g15_path_payload": (
        "from_, to_, hops, own:BIGINT",
        [
            ('amount', 'stg_orders', 'amount>stg_orders>totals>ranked>sales', 0), ('amount', 'totals', 'amount>totals>ranked>sales', 0), ('output', 'sales', 'stg_orders>totals>ranked>output>sales', 3),
            ('r@14', 'sales', 'stg_orders>totals>ranked>r@14>sales', 3), ('ranked', 'output', 'stg_orders>totals>ranked>output>sales', 2), ('ranked', 'r@14', 'stg_orders>totals>ranked>r@14>sales', 2),
            ('ranked', 'sales', 'stg_orders>totals>ranked>sales', 2), ('stg_orders', 'totals', 'stg_orders>totals>ranked>sales', 0), ('t@8', 'ranked', 'stg_orders>totals>t@8>ranked>sales', 2),
            ('totals', 'ranked', 'stg_orders>totals>ranked>sales', 1), ('totals', 't@8', 'stg_orders>totals>t@8>ranked>sales', 1),
        ],
    ),
    "g17_response": (
        "script, what, in_flow, n:BIGINT",
        [
            ('a_load.sql', 'edges', 'no flow', 32), ('a_load.sql', 'nodes', 'no flow', 12), ('c_join.sql', 'edges', 'false', 43), ('c_join.sql', 'edges', 'true', 25), ('c_join.sql', 'nodes', 'false', 11),
            ('c_join.sql', 'nodes', 'true', 16), ('h_hive.sql', 'edges', 'false', 24), ('h_hive.sql', 'edges', 'true', 8), ('h_hive.sql', 'nodes', 'false', 9), ('h_hive.sql', 'nodes', 'true', 5),
        ],
    ),
    "i01_field_index": (
        "field, tables, scripts",
        [
            ('amount', 'open_orders,stg_orders,u', 'a_load.sql,c_join.sql,f_merge.sql,h_hive.sql,i_tables.ddl,j_ambiguous.sql,k_window.sql'), ('ok', 'kept', 'd_summary.sql,i_tables.ddl'),
            ('place', 'ranked,sales', 'c_join.sql,d_summary.sql'), ('segment', 'sales,stg_customers,summary', 'b_customers.sql,c_join.sql,d_summary.sql,e_report.sql,i_tables.ddl,j_ambiguous.sql'),
        ],
    ),
    "i04_filter_payload": (
        "n_scripts:BIGINT, n_tables:BIGINT, n_fields:BIGINT, n_dropped:BIGINT, ignored, warning",
        [
            (2, 2, 4, 1, 'elsewhere', 'tables of the second file are not in the first'),
        ],
    ),
    "i06_lookups": (
        "asked, found",
        [
            ('fields of sales', 'band'), ('fields of sales', 'cust_id'), ('fields of sales', 'name'), ('fields of sales', 'place'), ('fields of sales', 'segment'), ('fields of sales', 'total'),
            ('tables of cust_id', 'blocked'), ('tables of cust_id', 'kept'), ('tables of cust_id', 'ranked'), ('tables of cust_id', 'sales'), ('tables of cust_id', 'stg_customers'), ('tables of cust_id', 'stg_orders'),
            ('tables of cust_id', 'totals'), ('tables of cust_id', 'u'),
        ],
    ),
    "i09_accuracy_score": (
        "name, score:DOUBLE",
        [
            ('all', 1.0), ('half', 0.5), ('span', 0.15), ('words', 0.35),
        ],
    ),
    "i10_partition_metrics": (
        "script, coverage:DOUBLE, overlap:DOUBLE, gap:DOUBLE, redundancy:DOUBLE",
        [
            ('a_load.sql', 0.6667, 0.0, 0.3333, 1.0), ('c_join.sql', 0.9333, 0.0, 0.0667, 1.0), ('e_report.sql', 1.0, 0.0, 0.0, 1.0),
        ],
    ),
    "p05_star_expansion": (
        "script, context, tbl, field",
        [
            ('star.sql', 'TOP0', 'stg_customers', 'cust_id'), ('star.sql', 'TOP0', 'stg_customers', 'name'), ('star.sql', 'TOP0', 'stg_customers', 'nation'), ('star.sql', 'TOP0', 'stg_customers', 'segment'),
        ],
    ),
    "r_workspace_schema": (
        "col, tbl, strategy, owners",
        [
            ('f1', 'p', 'workspace', 'p'), ('f2', '', 'ambiguous', 'p,q'), ('f3', 'q', 'workspace', 'q'),
        ],
    ),
    "s04_tree": (
        "path, kind, depth:BIGINT, place:BIGINT",
        [
            ('A.sql', 'file', 0, 7), ('Ends', 'folder', 0, 1), ('Ends/x.sql', 'file', 1, 2), ('b.sql', 'file', 0, 8), ('steps', 'folder', 0, 3), ('steps/deep', 'folder', 1, 4), ('steps/deep/one.sql', 'file', 2, 5),
            ('steps/two.sql', 'file', 1, 6),
        ],
    ),
    "s07_output_columns": (
        "table_name, data_type, column_name, explanation",
        [
            ('a,b', 'INT', 'c', 'd,e'), ('sales', 'DECIMAL', 'total', 'what a customer paid'), ('summary', 'VARCHAR', 'segment', ''),
        ],
    ),
    "s09_written_indexes": (
        "name, n:BIGINT",
        [
            ('field_index', 31), ('orphan_fields', 2), ('pair_index', 51), ('table_index', 18),
        ],
    ),
    "s11_graph_json": (
        "script, n_nodes:BIGINT, n_edges:BIGINT, n_lost:BIGINT",
        [
            ('a_load.sql', 12, 32, 0), ('c_join.sql', 27, 68, 0), ('l_broken.sql', 3, 1, 0),
        ],
    ),
    "s19_template_variables": (
        "script, variable, n:BIGINT, warning",
        [
            ('t.sql', 'day', 1, 'template variable day is not replaced'), ('t.sql', 'low', 2, 'template variable low is not replaced'),
        ],
    ),
    "f03_parse_fallback": (
        "given, dialect, taken",
        [
            ('SELECT "a" FROM "b"."t"', 'hive', 'SELECT `a` FROM `b`.`t`'), ('SELECT FROM WHERE (', '', ''), ('SELECT TOP 3 a FROM t WITH (NOLOCK)', 'tsql', 'SELECT   a FROM t LIMIT 3'),
            ('SELECT [x].[a] FROM [dbo].[t] AS [x]', 'hive', 'SELECT `x`.`a` FROM `dbo`.`t` AS `x`'),
            ('SELECT a FROM t QUALIFY row_number() OVER (ORDER BY a) = 1', 'snowflake', 'SELECT * EXCEPT (_q) FROM (SELECT row_number() OVER (ORDER BY a) AS _q, a FROM t ) WHERE _q = 1'),
            ('SELECT a FROM t', 'mysql', 'SELECT a FROM t'),
        ],
    ),
    "i08_topology": (
        "script, check, n:BIGINT",
        [
            ('f_merge.sql', 'further components', 1), ('h_hive.sql', 'further components', 1), ('j_ambiguous.sql', 'isolated nodes', 1), ('l_broken.sql', 'isolated nodes', 1),
        ],
    ),
    "dg_dependencies": (
        "script, relationship, operation, n:BIGINT",
        [
            ('a_load.sql', 'ALIAS', 'ALIAS', 1), ('a_load.sql', 'DML', 'INSERT', 9), ('a_load.sql', 'FILTER', 'CONDITION', 2), ('a_load.sql', 'REF', 'READ', 7), ('a_load.sql', 'REF', 'REFERENCE', 2),
            ('a_load.sql', 'SCHEMA', 'OUTPUT', 5), ('a_load.sql', 'SCHEMA', 'TABLE_COLUMN', 3), ('a_load.sql', 'TABLE_FLOW', 'FROM', 1), ('a_load.sql', 'TABLE_FLOW', 'INSERT', 1),
            ('a_load.sql', 'TRANSFORM', 'REFERENCE', 1), ('b_customers.sql', 'ALIAS', 'ALIAS', 3), ('b_customers.sql', 'DML', 'INSERT', 10), ('b_customers.sql', 'JOIN', 'JOIN_CONDITION', 4),
            ('b_customers.sql', 'REF', 'READ', 8), ('b_customers.sql', 'REF', 'REFERENCE', 1), ('b_customers.sql', 'SCHEMA', 'OUTPUT', 4), ('b_customers.sql', 'SCHEMA', 'TABLE_COLUMN', 5),
            ('b_customers.sql', 'TABLE_FLOW', 'FROM', 3), ('b_customers.sql', 'TABLE_FLOW', 'INSERT', 3), ('b_customers.sql', 'TRANSFORM', 'REFERENCE', 1), ('c_join.sql', 'AGGREGATE', 'REFERENCE', 1),
            ('c_join.sql', 'ALIAS', 'ALIAS', 3), ('c_join.sql', 'COMPUTED', 'REFERENCE', 1), ('c_join.sql', 'DML', 'INSERT', 10), ('c_join.sql', 'JOIN', 'JOIN_CONDITION', 2), ('c_join.sql', 'REF', 'READ', 11),
            ('c_join.sql', 'REF', 'REFERENCE', 6), ('c_join.sql', 'SCHEMA', 'CTE_BODY', 10), ('c_join.sql', 'SCHEMA', 'OUTPUT', 6), ('c_join.sql', 'SCHEMA', 'TABLE_COLUMN', 5), ('c_join.sql', 'TABLE_FLOW', 'FROM', 4),
            ('c_join.sql', 'TABLE_FLOW', 'INSERT', 3), ('c_join.sql', 'TABLE_FLOW', 'REFERENCE', 4), ('c_join.sql', 'TRANSFORM', 'REFERENCE', 1), ('c_join.sql', 'WINDOW', 'REFERENCE', 1),
            ('d_summary.sql', 'AGGREGATE', 'REFERENCE', 2), ('d_summary.sql', 'ALIAS', 'ALIAS', 1), ('d_summary.sql', 'DML', 'INSERT', 9), ('d_summary.sql', 'DML', 'UPDATE', 2),
            ('d_summary.sql', 'DML', 'WRITE_READ', 1), ('d_summary.sql', 'FILTER', 'CONDITION', 1), ('d_summary.sql', 'REF', 'READ', 8), ('d_summary.sql', 'REF', 'REFERENCE', 1),
            ('d_summary.sql', 'SCHEMA', 'OUTPUT', 4), ('d_summary.sql', 'SCHEMA', 'TABLE_COLUMN', 3), ('d_summary.sql', 'TABLE_FLOW', 'FROM', 2), ('d_summary.sql', 'TABLE_FLOW', 'INSERT', 1),
            ('d_summary.sql', 'TABLE_FLOW', 'SUBSELECT', 1), ('d_summary.sql', 'TRANSFORM', 'REFERENCE', 1), ('e_report.sql', 'AGGREGATE', 'REFERENCE', 1), ('e_report.sql', 'ALIAS', 'ALIAS', 3),
            ('e_report.sql', 'FILTER', 'CONDITION', 3), ('e_report.sql', 'INDIRECT', 'CORRELATED', 1), ('e_report.sql', 'INDIRECT', 'CORRELATED_OUT', 3), ('e_report.sql', 'REF', 'READ', 5),
            ('e_report.sql', 'SCHEMA', 'OUTPUT', 5), ('e_report.sql', 'SCHEMA', 'TABLE_COLUMN', 5), ('e_report.sql', 'TABLE_FLOW', 'FROM', 3), ('e_report.sql', 'TABLE_FLOW', 'SUBSELECT', 2),
            ('f_merge.sql', 'ALIAS', 'ALIAS', 1), ('f_merge.sql', 'DML', 'DELETE', 1), ('f_merge.sql', 'DML', 'MERGE', 4), ('f_merge.sql', 'JOIN', 'JOIN_CONDITION', 2), ('f_merge.sql', 'REF', 'READ', 7),
            ('f_merge.sql', 'REF', 'REFERENCE', 2), ('f_merge.sql', 'SCHEMA', 'OUTPUT', 2), ('f_merge.sql', 'SCHEMA', 'TABLE_COLUMN', 3), ('f_merge.sql', 'TABLE_FLOW', 'FROM', 1),
            ('f_merge.sql', 'TRANSFORM', 'REFERENCE', 1), ('g_union.sql', 'ALIAS', 'ALIAS', 1), ('g_union.sql', 'DML', 'CREATE', 5), ('g_union.sql', 'REF', 'READ', 7), ('g_union.sql', 'REF', 'REFERENCE', 3),
            ('g_union.sql', 'SCHEMA', 'OUTPUT', 8), ('g_union.sql', 'SCHEMA', 'TABLE_COLUMN', 4), ('g_union.sql', 'SET_OP', 'BRANCH', 3), ('g_union.sql', 'SET_OP', 'SET', 1), ('g_union.sql', 'TABLE_FLOW', 'CREATE', 1),
            ('g_union.sql', 'TABLE_FLOW', 'FROM', 3), ('g_union.sql', 'TABLE_FLOW', 'SUBSELECT', 3), ('g_union.sql', 'TRANSFORM', 'REFERENCE', 1), ('h_hive.sql', 'ALIAS', 'ALIAS', 2), ('h_hive.sql', 'DML', 'INSERT', 8),
            ('h_hive.sql', 'FILTER', 'CONDITION', 2), ('h_hive.sql', 'REF', 'READ', 6), ('h_hive.sql', 'SCHEMA', 'OUTPUT', 4), ('h_hive.sql', 'SCHEMA', 'TABLE_COLUMN', 6), ('h_hive.sql', 'TABLE_FLOW', 'FROM', 2),
            ('h_hive.sql', 'TABLE_FLOW', 'INSERT', 2), ('j_ambiguous.sql', 'REF', 'READ', 4), ('j_ambiguous.sql', 'SCHEMA', 'OUTPUT', 5), ('j_ambiguous.sql', 'TABLE_FLOW', 'FROM', 2),
            ('k_window.sql', 'ALIAS', 'ALIAS', 1), ('k_window.sql', 'INDIRECT', 'NAME_MATCH', 1), ('k_window.sql', 'REF', 'READ', 3), ('k_window.sql', 'SCHEMA', 'OUTPUT', 3),
            ('k_window.sql', 'SCHEMA', 'TABLE_COLUMN', 3), ('k_window.sql', 'TABLE_FLOW', 'FROM', 1), ('k_window.sql', 'WINDOW', 'REFERENCE', 5), ('l_broken.sql', 'DML', 'INSERT', 1),
        ],
    ),
    "l_walk": (
        "name, distance:BIGINT",
        [
            ('band@TOP0', 3), ('c@TOP0', 4), ('place@CTE{ranked}', 2), ('place@TOP0', 3), ('r.total@TOP0', 2), ('r@TOP0', 4), ('ranked@CTE{ranked}', 3), ('ranked@TOP0', 3), ('sales@TOP0', 3),
            ('stg_orders@CTE{totals}', 5), ('t.total@CTE{ranked}', 1), ('t@CTE{ranked}', 3), ('total@CTE{totals}', 0), ('total@TOP0', 3), ('totals@CTE{ranked}', 2), ('totals@CTE{totals}', 4), ('⟐ output@TOP0', 4),
        ],
    ),
    "l08_flow_roles": (
        "name, role",
        [
            ('amount@CTE{totals}', 'source'), ('band@TOP0', 'waypoint'), ('c.cust_id@TOP0', 'source'), ('c@TOP0', 'source'), ('cust_id@CTE{totals}', 'source'), ('cust_id@TOP0', 'source'), ('n@CTE{totals}', 'waypoint'),
            ('name@TOP0', 'source'), ('place@CTE{ranked}', 'waypoint'), ('place@TOP0', 'source'), ('r.cust_id@TOP0', 'source'), ('r.total@TOP0', 'source'), ('r@TOP0', 'source'), ('ranked@CTE{ranked}', 'target'),
            ('ranked@TOP0', 'target'), ('sales@TOP0', 'target'), ('segment@TOP0', 'source'), ('stg_customers@TOP0', 'target'), ('stg_orders@CTE{totals}', 'target'), ('t.cust_id@CTE{ranked}', 'source'),
            ('t.total@CTE{ranked}', 'source'), ('t@CTE{ranked}', 'source'), ('total@CTE{totals}', 'waypoint'), ('total@TOP0', 'waypoint'), ('totals@CTE{ranked}', 'target'), ('totals@CTE{totals}', 'waypoint'),
            ('⟐ output@TOP0', 'target'),
        ],
    ),
    "si_schema": (
        "tbl, fields",
        [
            ('c_join.sql#c', 'cust_id,name,nation,segment'), ('k_window.sql#o', 'amount,cust_id,day,order_id,status'),
        ],
    ),
    "dg_writes": (
        "script, source, target, relationship, operation",
        [
            ('having.sql', 'total@TOP0', 'total@TOP0', 'INDIRECT', 'NAME_MATCH'), ('self.sql', 'a.boss@TOP0', 'staff@TOP0', 'DML', 'INSERT'), ('self.sql', 'a.id@TOP0', 'staff@TOP0', 'DML', 'INSERT'),
            ('self.sql', 'b.boss@TOP0', 'staff@TOP0', 'DML', 'INSERT'), ('self.sql', 'b.id@TOP0', 'staff@TOP0', 'DML', 'INSERT'), ('self.sql', 'staff@TOP0', 'staff@TOP0', 'TABLE_FLOW', 'SELF_JOIN'),
            ('self.sql', '⟐ output@TOP0', 'staff@TOP0', 'DML', 'INSERT'), ('writes.sql', 'acc.bal@TOP0', 'acc@TOP0', 'DML', 'UPDATE'), ('writes.sql', 'acc@TOP0', 'a@TOP2', 'DML', 'WRITE_READ'),
            ('writes.sql', 'acc@TOP0', 'acc@TOP1', 'DML', 'WRITE_READ'), ('writes.sql', 'acc@TOP0', 'acc@TOP2', 'DML', 'WRITE_READ'), ('writes.sql', 'acc@TOP1', 'a@TOP2', 'DML', 'WRITE_READ'),
            ('writes.sql', 'acc@TOP1', 'acc@TOP2', 'DML', 'WRITE_READ'), ('writes.sql', 'bal@TOP1', 'acc@TOP1', 'DML', 'DELETE'), ('writes.sql', 'id@TOP0', 'acc@TOP0', 'DML', 'UPDATE'),
            ('writes.sql', 'n@TOP2', 'log@TOP2', 'DML', 'INSERT'), ('writes.sql', '⟐ output@TOP2', 'log@TOP2', 'DML', 'INSERT'),
        ],
    ),
    "p02_names": (
        "name, variable_type, is_output:BOOLEAN",
        [
            ("'a text that is longer than th", 'literal', True), ('12345', 'literal', True), ('c', 'column', True), ('coalesce(d, 0)', 'transform', True), ('sum(e) OVER (PARTITION BY f)', 'window', True),
            ('t.a', 'column', True),
        ],
    ),
    "f05_statements": (
        "script, statement:BIGINT, kind, target, line_start:BIGINT, line_end:BIGINT",
        [
            ('a_load.sql', 0, 'INSERT', 'stg_orders', 2, 5), ('b_customers.sql', 0, 'INSERT', 'stg_customers', 1, 6), ('c_join.sql', 0, 'INSERT', 'sales', 1, 14), ('d_summary.sql', 0, 'INSERT', 'summary', 1, 5),
            ('d_summary.sql', 1, 'UPDATE', 'summary', 6, 6), ('e_report.sql', 0, 'SELECT', '', 1, 5), ('f_merge.sql', 0, 'MERGE', 'sales', 1, 4), ('f_merge.sql', 1, 'DELETE', 'stg_orders', 5, 5),
            ('g_union.sql', 0, 'CTAS', 'people', 1, 6), ('g_union.sql', 1, 'CREATE VIEW', 'people_view', 7, 7), ('h_hive.sql', 0, 'INSERT', 'open_orders,done_orders', 2, 4),
            ('i_tables.ddl', 0, 'CREATE TABLE', 'stg_orders', 1, 1), ('i_tables.ddl', 1, 'CREATE TABLE', 'stg_customers', 2, 2), ('i_tables.ddl', 2, 'CREATE TABLE', 'kept', 3, 3),
            ('j_ambiguous.sql', 0, 'SELECT', '', 1, 3), ('k_window.sql', 0, 'SELECT', '', 1, 4), ('l_broken.sql', 0, 'SELECT', '', 1, 1), ('l_broken.sql', 1, 'INSERT', 'logs', 2, 2),
            ('l_broken.sql', 2, 'WITH', '', 3, 3),
        ],
    ),
    "f06_lines": (
        "script, name, context, line:BIGINT",
        [
            ('c_join.sql', 'amount', 'CTE{totals}', 2), ('c_join.sql', 'band', 'TOP0', 12), ('c_join.sql', 'c', 'TOP0', 13), ('c_join.sql', 'c.cust_id', 'TOP0', 14), ('c_join.sql', 'cust_id', 'CTE{totals}', 2),
            ('c_join.sql', 'cust_id', 'TOP0', 11), ('c_join.sql', 'n', 'CTE{totals}', 2), ('c_join.sql', 'name', 'TOP0', 11), ('c_join.sql', 'place', 'CTE{ranked}', 7), ('c_join.sql', 'place', 'TOP0', 11),
            ('c_join.sql', 'r', 'TOP0', 14), ('c_join.sql', 'r.cust_id', 'TOP0', 14), ('c_join.sql', 'r.total', 'TOP0', 11), ('c_join.sql', 'ranked', 'CTE{ranked}', 6), ('c_join.sql', 'ranked', 'TOP0', 14),
            ('c_join.sql', 'sales', 'TOP0', 10), ('c_join.sql', 'segment', 'TOP0', 11), ('c_join.sql', 'stg_customers', 'TOP0', 13), ('c_join.sql', 'stg_orders', 'CTE{totals}', 3), ('c_join.sql', 't', 'CTE{ranked}', 8),
            ('c_join.sql', 't.cust_id', 'CTE{ranked}', 7), ('c_join.sql', 't.total', 'CTE{ranked}', 7), ('c_join.sql', 'total', 'CTE{totals}', 2), ('c_join.sql', 'total', 'TOP0', 11),
            ('c_join.sql', 'totals', 'CTE{ranked}', 8), ('c_join.sql', 'totals', 'CTE{totals}', 1), ('c_join.sql', '⟐ output', 'TOP0', 11), ('d_summary.sql', 'band', 'TOP0', 4), ('d_summary.sql', 'cust_id', 'TOP0', 4),
            ('d_summary.sql', 'k', 'TOP0/subq0', 4), ('d_summary.sql', 'k.cust_id', 'TOP0/subq0', 4), ('d_summary.sql', 'k.ok', 'TOP0/subq0', 4), ('d_summary.sql', 'kept', 'TOP0/subq0', 4),
            ('d_summary.sql', 'mean_total', 'TOP0', 2), ('d_summary.sql', 'place', 'TOP0', 2), ('d_summary.sql', 'sales', 'TOP0', 3), ('d_summary.sql', 'segment', 'TOP0', 2), ('d_summary.sql', 'segment', 'TOP1', 6),
            ('d_summary.sql', 'summary', 'TOP0', 1), ('d_summary.sql', 'summary', 'TOP1', 6), ('d_summary.sql', 'summary.day_part', 'TOP0', 1), ('d_summary.sql', 'summary.mean_total', 'TOP1', 6),
            ('d_summary.sql', 'total', 'TOP0', 2), ('d_summary.sql', 'worst', 'TOP0', 2), ('d_summary.sql', '⟐ output', 'TOP0', 2), ('d_summary.sql', '⟐ output', 'TOP0/subq0', 4),
        ],
    ),
    "f01_preprocess": (
        "text:BIGINT, n_breaks:BIGINT, n_statements:BIGINT",
        [
            (0, 1, 1), (1, 3, 2), (2, 3, 2),
        ],
    ),
    "m09_table_definitions": (
        "script, tbl, col, line:BIGINT",
        [
            ('i_tables.ddl', 'kept', 'cust_id', 3), ('i_tables.ddl', 'kept', 'ok', 3), ('i_tables.ddl', 'stg_customers', 'cust_id', 2), ('i_tables.ddl', 'stg_customers', 'name', 2),
            ('i_tables.ddl', 'stg_customers', 'nation', 2), ('i_tables.ddl', 'stg_customers', 'segment', 2), ('i_tables.ddl', 'stg_orders', 'amount', 1), ('i_tables.ddl', 'stg_orders', 'cust_id', 1),
            ('i_tables.ddl', 'stg_orders', 'day', 1), ('i_tables.ddl', 'stg_orders', 'order_id', 1), ('i_tables.ddl', 'stg_orders', 'status', 1),
        ],
    ),
    "r_rules": (
        "qualifier, col, tbl, strategy",
        [
            ('', 'LEVEL', '⟐pseudo', 'pseudo'), ('', 'orders', '', ''), ('t', 'table_name', 'information_schema.tables', 'system'),
        ],
    ),
    "l16_uses": (
        "script, field, uses",
        [
            ('c_join.sql', 'amount', 'AGGREGATE,REF'), ('f_merge.sql', 'amount', 'REF'), ('f_merge.sql', 'status', 'DML,REF'), ('h_hive.sql', 'amount', 'DML,REF'), ('h_hive.sql', 'status', 'DML,FILTER,REF'),
            ('j_ambiguous.sql', 'amount', 'REF'), ('j_ambiguous.sql', 'status', 'REF'), ('k_window.sql', 'amount', 'REF,WINDOW'),
        ],
    ),
    "s08_analysis_cache": (
        "run:BIGINT, n_parsed:BIGINT, n_columns:BIGINT",
        [
            (0, 2, 2), (1, 0, 2), (2, 1, 3),
        ],
    ),
}
