"""Queries of this subpackage for __spark_entry__.py; SQL where it can express them (the README names the other tests)."""

from __future__ import annotations

from paperloom.llm import addresses, names, ocr_repair, packing, pairs, pii, tokens, truncation


def queries() -> dict:
    return {
        "p1_found": pii.p1_found,
        "p1_sanitised": pii.p1_sanitised,
        "p2_found": addresses.p2_found,
        "p2_locations": addresses.p2_locations,
        "p3_found": pairs.p3_found,
        "p3_defect_rates": pairs.p3_defect_rates,
        "p4_found": names.p4_found,
        "p4_entities": names.p4_entities,
        "p5_found": ocr_repair.p5_found,
        "p5_repaired": ocr_repair.p5_repaired,
        "p7_ids": tokens.p7_ids,
        "p7_round_trip": tokens.p7_round_trip,
        "p8_containers": packing.p8_containers,
        "p8_fill": packing.p8_fill,
        "p8_coverage": packing.p8_coverage,
        "p9_found": truncation.p9_found,
        "p9_rates": truncation.p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        # decoding the ids gives back every text
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        # every text is packed once into each capacity; only texts above a capacity have pieces
        "p8_coverage": "SELECT budget_id, count(*) AS texts, 0 AS overfull, 0 AS split_needlessly FROM documents, token_budgets GROUP BY 1",
    }
