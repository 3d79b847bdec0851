"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import archives, audio, decontaminate, disclosure, line_dedup, line_quality, mixture, near_dup, secret_scan, shards

QUERIES = {
    "op1_shard_slots": shards.op1_shard_slots,
    "op2_disclosure": disclosure.op2_disclosure,
    "op3_mix_sources": mixture.op3_mix_sources,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_near_dup": near_dup.op5_near_dup,
    "op6_telephony_audio": audio.op6_telephony_audio,
    "op7_line_quality": line_quality.op7_line_quality,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_warc_zip": archives.op10_warc_zip,
}

#: The others have no SQL form: tests hold them against brute force, exact round trips or held-out labels.
ORACLE_SQL = {
    "op2_disclosure": disclosure.OP2_SQL,
    "op3_mix_sources": mixture.OP3_SQL,
    "op4_secret_scan": secret_scan.OP4_SQL,
    "op5_near_dup": near_dup.OP5_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_warc_zip": archives.OP10_SQL,
}
