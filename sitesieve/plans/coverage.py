"""SURVEY §2 operator inventory → library function → registered query.

``tests/test_coverage.py`` checks that every function imports and every
query is registered with an oracle.
"""

COVERAGE = {
    "S1": ("sitesieve.sources.files.read_url_list", "read_url_list"),
    "S2": ("sitesieve.sources.files.read_result_txt", "read_result_txt"),
    "S3": ("sitesieve.sources.files.read_result_csv", "read_result_csv"),
    "S4": ("sitesieve.sources.files.read_results", "read_results"),
    "S5": ("sitesieve.sources.files.read_provider_report", "read_provider_report"),
    "S6": ("sitesieve.sources.files.align_to_schema", "align_to_schema"),
    "S7": ("sitesieve.sources.sinks.write_result_csv", "write_result_csv"),
    "S8": ("sitesieve.sources.sinks.write_result_txt", "write_result_txt"),
    "S9": ("sitesieve.sources.sinks.write_status_log", "write_status_log"),
    "S10": ("sitesieve.sources.sinks.append_session_results", "append_session_results"),
    "S11": ("sitesieve.sources.providers.parse_majestic_links", "parse_majestic_links"),
    "S12": ("sitesieve.sources.providers.parse_majestic_ref_domains", "parse_majestic_ref_domains"),
    "S13": ("sitesieve.sources.providers.parse_ahrefs_links", "parse_ahrefs_links"),
    "S14": ("sitesieve.sources.providers.parse_moz_links", "parse_moz_links"),
    "S15": ("sitesieve.sources.providers.parse_majestic_metrics", "parse_majestic_metrics"),
    "S16": ("sitesieve.sources.providers.parse_moz_metrics", "parse_moz_metrics"),
    "S17": ("sitesieve.sources.providers.parse_ahrefs_metrics", "parse_ahrefs_metrics"),
    "S18": ("sitesieve.sources.providers.parse_availability_json", "parse_availability_json"),
    "S19": ("sitesieve.sources.providers.parse_availability_lines", "parse_availability_lines"),
    "P1": ("sitesieve.operators.urls.with_url_parts", "with_url_parts"),
    "P2": ("sitesieve.operators.urls.registered_domain", "registered_domain"),
    "P3": ("sitesieve.operators.urls.trim_to_root", "trim_to_root"),
    "P4": ("sitesieve.operators.urls.trim_to_last_folder", "trim_to_last_folder"),
    "P5": ("sitesieve.operators.urls.keep_only_domain", "keep_only_domain"),
    "P6": ("sitesieve.operators.urls.replace_text", "replace_text"),
    "P7": ("sitesieve.operators.urls.replace_regex", "replace_regex"),
    "P8": ("sitesieve.operators.urls.replace_text_keep_scheme", "replace_text_keep_scheme"),
    "P9": ("sitesieve.operators.urls.remove_regex_mask", "remove_regex_mask"),
    "P10": ("sitesieve.operators.urls.clear_column", "clear_column"),
    "P11": ("sitesieve.operators.elements.decorate_items", "decorate_items"),
    "P12": ("sitesieve.operators.elements.split_custom_columns", "split_custom_columns"),
    "P13": ("sitesieve.operators.urls.coerce_metric_types", "coerce_metric_types"),
    "P14": ("sitesieve.operators.urls.with_status_class", "status_class"),
    "P15": ("sitesieve.operators.urls.display_round", "display_round"),
    "P16": ("sitesieve.operators.urls.decode_absolute_urls", "decode_absolute_urls"),
    "P17": ("sitesieve.functions.url.resolve_url", "resolve_url"),
    "P18": ("sitesieve.operators.urls.with_rendered_line", "render_lines"),
    "P19": ("sitesieve.operators.urls.with_split_platform", "split_platform"),
    "P20": ("sitesieve.operators.urls.fill_timeouts", "fill_timeouts"),
    "P21": ("sitesieve.operators.content.strip_item_html", "strip_item_html"),
    "F1": ("sitesieve.operators.filters.remove_bad_urls", "remove_bad_urls"),
    "F2": ("sitesieve.operators.filters.remove_subdomains", "remove_subdomains"),
    "F3": ("sitesieve.operators.filters.drop_containing", "drop_containing"),
    "F4": ("sitesieve.operators.filters.drop_not_containing", "drop_not_containing"),
    "F5": ("sitesieve.operators.filters.drop_matching", "drop_matching"),
    "F6": ("sitesieve.operators.filters.drop_not_matching", "drop_not_matching"),
    "F7": ("sitesieve.operators.filters.drop_equal", "drop_equal"),
    "F8": ("sitesieve.operators.filters.drop_not_equal", "drop_not_equal"),
    "F9": ("sitesieve.operators.filters.drop_lower", "drop_lower"),
    "F10": ("sitesieve.operators.filters.drop_higher", "drop_higher"),
    "F11": ("sitesieve.operators.filters.drop_selected", "drop_selected"),
    "F12": ("sitesieve.operators.filters.apply_http_guard", "apply_http_guard"),
    "F13": ("sitesieve.operators.filters.apply_content_guard", "apply_content_guard"),
    "F14": ("sitesieve.operators.filters.pending", "pending"),
    "F15": ("sitesieve.operators.filters.redirect_candidates", "redirect_candidates"),
    "F16": ("sitesieve.operators.filters.drop_empty_items", "drop_empty_items"),
    "J1": ("sitesieve.operators.enrich.update_by_url", "update_by_url"),
    "J2": ("sitesieve.operators.enrich.update_by_domain", "update_by_domain"),
    "J3": ("sitesieve.operators.enrich.update_by_pair", "update_by_pair"),
    "J4": ("sitesieve.operators.enrich.enrich_status", "enrich_status"),
    "J5": ("sitesieve.operators.enrich.resolve_redirect_once", "resolve_redirect_once"),
    "J6": ("sitesieve.plans.loops.resolve_redirect_chain", "resolve_redirect_chain"),
    "J7": ("sitesieve.operators.enrich.enrich_ip", "enrich_ip"),
    "J8": ("sitesieve.operators.enrich.enrich_availability", "enrich_availability"),
    "J9": ("sitesieve.operators.enrich.enrich_backlinks", "enrich_backlinks"),
    "J10": ("sitesieve.operators.content.link_alive", "link_alive"),
    "J11": ("sitesieve.operators.frontier.expand_customs", "expand_customs"),
    "J12": ("sitesieve.operators.platform.match_platform_rules", "match_platform_rules"),
    "J13": ("sitesieve.operators.rules.list_rules", "list_rules"),
    "J14": ("sitesieve.plans.loops.follow_pagination", "follow_pagination"),
    "A1": ("sitesieve.operators.dedup.dedup_urls", "dedup_urls"),
    "A2": ("sitesieve.operators.dedup.dedup_domains", "dedup_domains"),
    "A3": ("sitesieve.operators.dedup.distinct_first", "distinct_first"),
    "A4": ("sitesieve.operators.enrich.count_filled", "count_filled"),
    "A5": ("sitesieve.operators.enrich.count_redirects", "count_redirects"),
    "A6": ("sitesieve.operators.enrich.domain_histogram", "domain_histogram"),
    "A7": ("sitesieve.operators.enrich.crawl_concurrency", "crawl_concurrency"),
    "A8": ("sitesieve.operators.content.outbound_links", "outbound_links"),
    "A9": ("sitesieve.operators.content.dofollow_pct", "dofollow_pct"),
    "A10": ("sitesieve.operators.enrich.bulk_batches", "bulk_batches"),
    "A11": ("sitesieve.operators.enrich.items_per_page", "items_per_page"),
    "A12": ("sitesieve.operators.enrich.enrichment_progress", "enrichment_progress"),
    "A13": ("sitesieve.operators.enrich.frontier_remaining", "frontier_remaining"),
    "O1": ("sitesieve.operators.dedup.sort_by", "sort_by"),
    "O2": ("sitesieve.operators.dedup.page_of", "page_of"),
    "O3": ("sitesieve.operators.dedup.frontier_slice", "frontier_slice"),
    "U1": ("sitesieve.operators.sets.merge_into_list", "merge_into_list"),
    "U2": ("sitesieve.operators.sets.diff_with_list", "diff_with_list"),
    "U3": ("sitesieve.operators.sets.append_rows", "append_rows"),
    "U4": ("sitesieve.operators.sets.replace_or_append", "replace_or_append"),
    "C1": ("sitesieve.operators.content.extract_links", "extract_links"),
    "C2": ("sitesieve.operators.elements.extract_elements", "extract_elements"),
    "C3": ("sitesieve.operators.elements.extract_items", "extract_items"),
    "C4": ("sitesieve.operators.elements.next_page", "next_page"),
    "C5": ("sitesieve.operators.content.robots_nofollow", "robots_nofollow"),
    "C6": ("sitesieve.operators.platform.detect_platform", "detect_platform"),
    "C7": ("sitesieve.functions.jsonpick.json_pick", "json_pick"),
    "C8": ("sitesieve.functions.jsonpick.json_items", "json_items"),
    "C9": ("sitesieve.operators.content.detect_charset", "detect_charset"),
    "G1": ("sitesieve.operators.frontier.frontier_footprint", "frontier_footprint"),
    "G2": ("sitesieve.operators.frontier.frontier_customs", "frontier_customs"),
    "G3": ("sitesieve.operators.frontier.int_loop", "int_loop"),
    "G4": ("sitesieve.operators.frontier.drop_unused_lists", "drop_unused_lists"),
    "G5": ("sitesieve.operators.frontier.first_of_macro", "first_of_macro"),
    "G6": ("sitesieve.operators.frontier.suggest_wildcard", "suggest_wildcard"),
    "T1": ("sitesieve.streaming.streams.stream_links", "stream_append"),
    "T1 items": ("sitesieve.streaming.streams.stream_items", "stream_items"),
    "T2": ("sitesieve.streaming.streams.stream_dedup", "stream_dedup"),
    "T3": ("sitesieve.streaming.streams.stream_counts", "stream_counts"),
    "L1": ("sitesieve.plans.jobs.clean_and_enrich", "clean_and_enrich"),
    "L2": ("sitesieve.plans.jobs.scrape_snapshot", "scrape_snapshot"),
    "L3": ("sitesieve.plans.jobs.ingest_backlinks", "ingest_backlinks"),
}
