"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from leakloom.llm import bpe, chat, decontaminate, licenses, line_dedup, pii, quality, simhash, token_counts, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_toxicity": toxicity.op3,
    "op4_token_counts": token_counts.op4,
    "op5_pii": pii.op5,
    "op6_simhash_near_dedup": simhash.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_benchmark_decontamination": decontaminate.op8,
    "op9_license_scans": licenses.op9,
    "op10_chat_formatting": chat.op10,
}

_LENGTH = r"length(regexp_replace({}, '[\\\\\[\]<]', 'xx', 'g'))"

#: Of an example: 7 characters around it, 5 around each turn besides its role twice and its text, 13 of the marks of its target.
ORACLES: dict[str, str] = {
    "op10_chat_formatting": f"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no, count(*) OVER (PARTITION BY conv_id) AS last, 5 + 2 * {_LENGTH.format('role')} + {_LENGTH.format('text')} AS n FROM rows),
summed AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY no) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN upto + 20 WHEN no = last THEN upto + 7 ELSE 0 END) AS BIGINT) AS formatted_chars FROM summed GROUP BY conv_id""",
}
