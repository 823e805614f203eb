"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from . import bpe, decontaminate, exact_dedup, html_crf, langid, license_scan, link_graph, near_dedup, sharding, wavelet

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_sharding": sharding.op2_sharding,
    "op3_url_filter": link_graph.op3_url_filter,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_html_extract": html_crf.op8_html_extract,
    "op9_token_shards": wavelet.op9_token_shards,
    "op10_language_id": langid.op10_language_id,
}
ORACLE_SQL = {
    "op3_url_filter": link_graph.oracle(),
    "op5_exact_dedup": exact_dedup.ORACLE,
}
