"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, htmltext, langid, lattice, license, mixing, pii, simhash, tiff, tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": lattice.op1_lattice,
    "op2_langid": langid.op2_langid,
    "op3_simhash": simhash.op3_simhash,
    "op4_tiff": tiff.op4_tiff,
    "op5_license": license.op5_license,
    "op6_mixing": mixing.op6_mixing,
    "op7_bpe": bpe.op7_bpe,
    "op8_tokenfile": tokenfile.op8_tokenfile,
    "op9_pii": pii.op9_pii,
    "op10_htmltext": htmltext.op10_htmltext,
}
SQL: dict[str, str] = {
    "op6_mixing": mixing.SQL,
}
