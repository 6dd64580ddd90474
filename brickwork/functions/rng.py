"""Counter-based random columns.

A draw depends only on (seed, row identity, stream name).  It is therefore
independent of partitioning, safe under task retry, and identical in two
scenarios that share the row, which is what matched samples rely on.

One md5 per row gives four 28-bit words; every stream then costs a handful of
64-bit integer operations inside whole-stage codegen instead of another digest.
The first step is a universal hash of the words modulo a prime; the shift of
the second product removes the linear relation between streams of one row.
All products stay below 2**62, so ANSI overflow checks never fire.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import derive

PRIME = 2_147_483_647  # 2**31 - 1
WORDS = 4
HEX_PER_WORD = 7
HIGH_BIT = 1 << 30


@lru_cache(maxsize=4096)
def stream_constants(name: str) -> tuple[int, ...]:
    """Seven multipliers and offsets in [1, PRIME) for one stream name."""
    wide = hashlib.sha256(name.encode()).digest()
    return tuple(
        int.from_bytes(wide[i * 4 : i * 4 + 4], "big") % (PRIME - 1) + 1 for i in range(7)
    )


@dataclass(frozen=True)
class Keyed:
    """Row identity already reduced to word columns named ``{prefix}0..3``."""

    prefix: str = "_rk"
    scope: str = ""

    def columns(self) -> list[str]:
        return [f"{self.prefix}{i}" for i in range(WORDS)]

    def scoped(self, scope: str) -> Keyed:
        """The same rows with an independent set of streams."""
        return Keyed(self.prefix, scope)

    def uniform_sql(self, name: str) -> str:
        a, b, c, d, e, m, f = stream_constants(f"{self.scope}{name}")
        w = self.columns()
        t = f"(({w[0]} * {a}L + {w[1]} * {b}L + {w[2]} * {c}L + {w[3]} * {d}L + {e}L) % {PRIME}L)"
        return f"((shiftright({t} * {m | HIGH_BIT}L + {f}L, 21) % {PRIME}L + 0.5D) / {float(PRIME)!r}D)"

    def normal_sql(self, name: str) -> str:
        u1, u2 = self.uniform_sql(f"{name}#1"), self.uniform_sql(f"{name}#2")
        return f"(sqrt(-2.0D * ln({u1})) * cos({2.0 * math.pi!r}D * {u2}))"

    def uniform(self, name: str) -> Column:
        """Uniform on the open interval (0, 1)."""
        return F.expr(self.uniform_sql(name))

    def normal(self, name: str) -> Column:
        """Standard normal by Box-Muller from two uniform streams."""
        return F.expr(self.normal_sql(name))


def digest(seed: int | str, ids: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def with_row_key(
    df: DataFrame, seed: int | str, ids: Sequence[str], prefix: str = "_rk"
) -> tuple[DataFrame, Keyed]:
    """Attach the row words; call once per row identity, draw as often as needed."""
    tagged = df.withColumn(f"{prefix}h", digest(seed, ids))
    words = {
        f"{prefix}{i}": f"bigint(conv(substr({prefix}h, {1 + i * HEX_PER_WORD}, {HEX_PER_WORD}), 16, 10))"
        for i in range(WORDS)
    }
    return derive(tagged, words).drop(f"{prefix}h"), Keyed(prefix)
