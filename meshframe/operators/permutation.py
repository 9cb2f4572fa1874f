"""A keyed permutation of dense ids, as column arithmetic."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the Mersenne prime of the round function; products of two residues fit 63 bits.
PRIME = (1 << 31) - 1
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 to n - 1 that seed and epoch determine.

    An id is a pair (left, right) of residues modulo ``a`` and ``b``, where a * b is the least such product from n on with a
    near its root. A Feistel round adds a keyed function of one half to the other, which is undone by subtraction, so every
    round is one to one. Fewer than ``a`` pairs lie beyond n; an id that lands on one is sent on
    until it comes back below n ("cycle walking"), which keeps the whole one to one.
    """

    n: int
    seed: int
    epoch: int

    @property
    def a(self) -> int:
        return max(1, math.isqrt(max(self.n - 1, 0)) + 1)

    @property
    def b(self) -> int:
        return max(1, -(-self.n // self.a))

    @property
    def keys(self) -> list[tuple[int, int, int]]:
        """Three residues for each round; the factor is not zero."""
        out = []
        for r in range(ROUNDS):
            raw = hashlib.sha256(f"{self.seed}|{self.epoch}|{r}".encode()).digest()
            k = [int.from_bytes(raw[8 * i:8 * i + 8], "big") for i in range(3)]
            out.append((k[0] % PRIME, k[1] % PRIME, k[2] % (PRIME - 1) + 1))
        return out

    def once(self, number: int) -> int:
        """One pass of all rounds over an id below a * b."""
        left, right = divmod(number, self.b)
        for r, key in enumerate(self.keys):
            if r % 2:
                right = (right + _mixed(left, key)) % self.b
            else:
                left = (left + _mixed(right, key)) % self.a
        return left * self.b + right

    def of(self, number: int) -> int:
        """The permuted place of one id."""
        number = self.once(number)
        while number >= self.n:
            number = self.once(number)
        return number


def _mixed(x: int, key: tuple[int, int, int]) -> int:
    y = (x + key[0]) % PRIME
    y = (y * y + key[1]) % PRIME
    return y * y % PRIME * key[2] % PRIME


def _mixed_sql(x: str, k: str = "k") -> str:
    """The same of an expression, with the round's numbers in the fields of ``k``."""
    y = f"(({x} + {k}.u) % {PRIME})"
    y = f"(({y} * {y} + {k}.v) % {PRIME})"
    return f"({y} * {y} % {PRIME} * {k}.w % {PRIME})"


def _pass_sql(x: str, p: Permutation) -> str:
    """One pass in a single expression, of a size that does not depend on the rounds: a fold over their numbers."""
    rounds = ", ".join(
        f"named_struct('u', {u}L, 'v', {v}L, 'w', {w}L, 'odd', {'true' if r % 2 else 'false'})" for r, (u, v, w) in enumerate(p.keys))
    left = f"IF(k.odd, s.l, (s.l + {_mixed_sql('s.r')}) % {p.a}L)"
    right = f"IF(k.odd, (s.r + {_mixed_sql('s.l')}) % {p.b}L, s.r)"
    return (f"aggregate(array({rounds}), named_struct('l', {x} div {p.b}L, 'r', {x} % {p.b}L),"
            f" (s, k) -> named_struct('l', {left}, 'r', {right}), s -> s.l * {p.b}L + s.r)")


def permuted(df: DataFrame, ids: str, permutation: Permutation, out: str) -> DataFrame:
    """``df`` with the permuted place of each id in a column ``out``; no sort, no shuffle, no state.

    One expression of fixed size, so a filter on the place that Spark pushes down repeats little. The few ids that land
    beyond n walk on, in a fold over at most as many passes as there are places beyond n.
    """
    p = permutation
    beyond, first = p.a * p.b - p.n, _pass_sql(f"CAST(`{ids}` AS bigint)", p)
    if beyond:
        walk = f"aggregate(sequence(1, {beyond}), w, (x, i) -> IF(x < {p.n}L, x, {_pass_sql('x', p)}))"
        first = f"transform(array({first}), w -> IF(w < {p.n}L, w, {walk}))[0]"
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c != out], f"{first} AS `{out}`")


def dense_count(df: DataFrame, ids: str) -> int:
    """How many rows there are, checked to carry the ids from 0 on, each once: one aggregate with a row per task.

    Equal count, range, sum and sum of squares leave no room for repeats or gaps that occur in practice; a sum modulo a prime of
    the squares keeps the numbers small.
    """
    x = F.col(ids).cast("bigint")
    square = x % PRIME * (x % PRIME) % PRIME
    row = df.agg(F.count("*").alias("n"), F.count(x).alias("known"), F.min(x).alias("low"), F.max(x).alias("high"),
                 F.sum(x.cast("decimal(38,0)")).alias("total"), F.sum(square.cast("decimal(38,0)")).alias("squares")).first()
    n = row["n"]
    if n and (row["known"] != n or row["low"] != 0 or row["high"] != n - 1 or row["total"] != n * (n - 1) // 2
              or row["squares"] % PRIME != n * (n - 1) * (2 * n - 1) // 6 % PRIME):
        raise ValueError(f"{ids} does not run from 0 to {n - 1}, each once")
    return n
