"""Secrets: AES-256-GCM under a bound context, and revealing them to those who may."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strataq.functions.text import redacted, secret_label


def context(namespace: Column, scope: Column, id_: Column, label: Column) -> Column:
    """What a ciphertext is bound to: namespace, scope, and the secret's id and label."""
    return F.concat_ws(":", namespace, F.coalesce(scope, F.lit("")), F.lit("secret"), id_, label)


def check_key(key: bytes) -> bytes:
    if not isinstance(key, (bytes, bytearray)) or len(key) != 32:
        raise ValueError("a key has 32 bytes")
    return bytes(key)


def sealed(rows: DataFrame, key: bytes, text: str = "text", label: str = "label") -> DataFrame:
    """Rows with namespace, scope, id, a label and a text: the text gives way to its ciphertext (``sealed``) and a redacted one.

    The nonce is drawn anew for every row.
    """
    name = F.coalesce(F.nullif(F.trim(F.col(label)), F.lit("")), F.lit(secret_label(None)))
    rows = rows.withColumn(label, name)
    aad = context(F.col("namespace"), F.col("scope"), F.col("id"), F.col(label))
    cipher = F.aes_encrypt(F.col(text), F.lit(check_key(key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)
    return rows.withColumn("sealed", cipher).withColumn(text, F.concat(F.lit(redacted("x").removesuffix("x")), F.col(label))).withColumn("locked", F.lit(True))


def revealed(rows: DataFrame, key: bytes, allowed: Callable[[DataFrame], Column] | None = None, text: str = "text", label: str = "label") -> DataFrame:
    """Opens the secrets for which ``allowed`` gives a true column; others stay locked, all of them without a policy.

    A ciphertext that was moved to another namespace, scope, id or label doesn't open: its
    row stays locked, too.
    """
    aad = context(F.col("namespace"), F.col("scope"), F.col("id"), F.col(label))
    grant = F.lit(False) if allowed is None else F.coalesce(allowed(rows), F.lit(False))
    plain = F.when(grant & F.col("sealed").isNotNull(), F.try_aes_decrypt("sealed", F.lit(check_key(key)), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))
    out = rows.withColumn("_plain", plain)
    return out.withColumn(text, F.coalesce("_plain", F.col(text))).withColumn("locked", F.col("sealed").isNotNull() & F.col("_plain").isNull()).drop("_plain")
