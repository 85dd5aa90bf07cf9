"""Encryption and packing of columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableferry.functions.protect import decrypt, derive_key, encrypt, gzip_base64, unpack
from tableferry.plans.catalog.registry import query, table

KEY = derive_key("fixture secret", b"fixture salt")


@query("encrypt_roundtrip", "select c_custkey, c_name as clear, true as marked, c_mktsegment as plain from customer")
def encrypt_roundtrip(spark, sf):
    sealed = encrypt(F.col("c_name"), KEY)
    rows = table(spark, sf, "customer").select("c_custkey", sealed.alias("sealed"), "c_mktsegment")
    return rows.select(
        "c_custkey",
        decrypt(F.col("sealed"), KEY).alias("clear"),
        F.startswith("sealed", F.lit("ENC:")).alias("marked"),
        decrypt(F.col("c_mktsegment"), KEY).alias("plain"),
    )


@query("packed_roundtrip", "select doc_id, text from documents")
def packed_roundtrip(spark, sf):
    packed = F.concat(F.lit("GZ:"), gzip_base64(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", packed.alias("packed")).select(
        "doc_id", unpack(F.col("packed")).alias("text")
    )
