"""XXH3 in 64 bits over Arrow batches: shard numbers, digests.

Spark's own ``xxhash64`` is another hash; the one here is part of what callers
rely on, so that shards stay put between releases.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..errors import ConfigError

#: Fixed value: the seed of shard numbers, a part of the interface.
DEFAULT_SEED = 0x62616D73706C6974


def xxh3_hex(value: Column, seed: int = 0) -> Column:
    """16 hexadecimal digits of the hash of a binary value (null stays null)."""

    @arrow_udf("string")
    def hashed(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{xxhash.xxh3_64_intdigest(v, seed):016x}" for v in values.to_pylist()], pa.string())

    return hashed(value.cast("binary"))


def shard_number(value: Column, shards: int, seed: int = DEFAULT_SEED) -> Column:
    """The shard of a binary value, from 0; null for null."""
    if shards < 1:
        raise ConfigError("there must be at least one shard")

    @arrow_udf("bigint")
    def numbered(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else xxhash.xxh3_64_intdigest(v, seed) % shards for v in values.to_pylist()], pa.int64())

    return numbered(value.cast("binary"))


def shard_width(shards: int, width: int | None = None) -> int:
    """Digits of a shard's name: four at least, and as many as the last one needs."""
    natural = len(str(max(shards - 1, 0)))
    if width is None:
        return max(4, natural)
    if width < natural:
        raise ConfigError(f"width {width} is too small for {shards} shards")
    return width


def shard_name(number: Column, shards: int, width: int | None = None) -> Column:
    return F.concat(F.lit("shard-"), F.lpad(number.cast("string"), shard_width(shards, width), "0"))
