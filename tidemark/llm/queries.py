"""Registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat, collisions, collocations, langid, merkle, mixing, neardup, neighbours, pieces, sharding, telephony, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_sharding": sharding.op2_sharding,
    "op3_tool_calls": chat.op3_tool_calls,
    "op4_language_id": langid.op4_language_id,
    "op5_url_filter": urls.op5_url_filter,
    "op6_nearest": neighbours.op6_nearest,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_telephony": telephony.op9_telephony,
    "op10_mixing": mixing.op10_mixing,
    "op11_collocations": collocations.op11_collocations,
    "op12_linked": collisions.op12_linked,
    "op13_manifest": merkle.op13_manifest,
}

#: The others have no SQL: hashes and models that SQL lacks.  Their tests compare with brute force.
ORACLES: dict[str, str] = {
    "op3_tool_calls": chat.ORACLE,
    "op5_url_filter": urls.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_linked": collisions.ORACLE,
    "op13_manifest": merkle.ORACLE,
}
