"""Importing this module registers all queries of the library."""

from veldt.plans import baseline_queries, bundle_queries, company_view_queries, dataset_queries, event_queries, export_queries, graph_queries, review_queries, risk_queries, rule_queries, scoring_queries, stream_queries, taxonomy_queries, workbook_queries, workspace_queries  # noqa: F401
