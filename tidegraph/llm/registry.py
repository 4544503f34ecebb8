"""The queries of this subpackage and the SQL that DuckDB can hold some of them against."""

from __future__ import annotations

from . import decontaminate, language, licenses, mixing, neardup, ppm, quality, repeats, sharding, tokens

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_neardup": neardup.op2_neardup,
    "op3_tokens": tokens.op3_tokens,
    "op4_sharding": sharding.op4_sharding,
    "op5_repeats": repeats.op5_repeats,
    "op6_language": language.op6_language,
    "op7_mixing": mixing.op7_mixing,
    "op8_licenses": licenses.op8_licenses,
    "op9_quality": quality.op9_quality,
    "op10_ppm": ppm.op10_ppm,
}
SQL = {f"op{n}_{name}": module.SQL for n, name, module in ((1, "decontaminate", decontaminate), (2, "neardup", neardup), (4, "sharding", sharding), (5, "repeats", repeats), (6, "language", language), (7, "mixing", mixing), (9, "quality", quality), (10, "ppm", ppm))}
