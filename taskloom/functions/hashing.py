"""Stable hashes and shards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15


def folded_hash(text: Column) -> Column:
    """crc32, folded by 16 bits, times the golden ratio modulo 2**64, folded by 32 bits; as decimal(20, 0),
    since the value has 64 unsigned bits."""
    x = F.crc32(F.encode(text, "UTF-8"))
    x = x.bitwiseXOR(F.shiftright(x, 16))
    # 32 x 64 bits in two halves that stay below 2**63: the high product only matters modulo 2**32
    low, high = GOLDEN & 0xFFFFFFFF, GOLDEN >> 32
    half = lambda k: F.lit(str(k)).cast("decimal(38,0)")
    d = x.cast("decimal(20,0)")
    product = (d * half(high) % half(1 << 32)) * half(1 << 32) + d * half(low)
    product = (product % half(1 << 64)).cast("decimal(20,0)")
    top = F.floor(product / half(1 << 32)).cast("bigint")
    bottom = (product % half(1 << 32)).cast("bigint")
    return (top.cast("decimal(20,0)") * half(1 << 32) + top.bitwiseXOR(bottom).cast("decimal(20,0)")).cast("decimal(20,0)")


def content_hash(data: Column, size: Column, length: int = 40) -> Column:
    """sha-256 of an image's bytes and size, shortened."""
    return F.substring(F.sha2(F.concat(data, F.encode(size, "UTF-8")), 256), 1, length)


def shard_token(index: Column, factor: int | None = None) -> Column:
    """Ten episodes share a token; a factor folds the tokens."""
    token = F.floor(index / 10)
    return token if factor is None else F.pmod(token, F.lit(factor))


def episode_index(name: Column) -> Column:
    """Index in `episode_<digits>`, with or without folders and .parquet; null for other names."""
    return F.nullif(F.regexp_extract(name, r"episode_(\d+)(?:\.parquet)?$", 1), F.lit("")).cast("bigint")


def shard_of(name: Column, path: Column, world: int, factor: int | None = None) -> Column:
    """shard by the token of the first episode_<digits> anywhere in the name, by the folded hash of the path for names without one."""
    index = F.nullif(F.regexp_extract(name, r"episode_(\d+)", 1), F.lit("")).cast("bigint")
    own = F.pmod(shard_token(index, factor).cast("decimal(20,0)"), F.lit(world))
    return F.coalesce(own, F.pmod(folded_hash(path), F.lit(world))).cast("int")


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only; in place of a random stream."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
