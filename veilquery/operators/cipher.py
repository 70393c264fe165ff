"""Encryption schemes: how query elements, column sums and decryption work.

``NullScheme`` has the arithmetic without secrecy; ``PaillierScheme`` is additively
homomorphic.  Its integers are Python's, not constant-time: for research, not for
protecting real secrets.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass, field


@dataclass(frozen=True)
class NullScheme:
    """Sums of element times chunk, in the clear."""

    name = "null"

    def element(self, plain: int) -> int:
        return plain

    def neutral(self) -> int:
        return 0

    def add(self, a: int, b: int) -> int:
        return a + b

    def times(self, element: int, n: int) -> int:
        return element * n

    def decrypt(self, c: int) -> int:
        return c

    def public(self) -> NullScheme:
        return self

    def capacity(self) -> int:
        """Bytes that a column's plaintext can hold (any number here)."""
        return 1 << 20

    def most_chunk_size(self, selectors: int) -> int:
        """The largest chunk, in bytes, that a query may ask for."""
        return 16


def _is_prime(n: int, rounds: int = 40) -> bool:
    if n < 4:
        return n > 1
    if any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for _ in range(rounds):
        x = pow(secrets.randbelow(n - 3) + 2, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _prime(bits: int) -> int:
    while True:
        n = secrets.randbits(bits) | 1 | 3 << (bits - 2)
        if _is_prime(n):
            return n


@dataclass(frozen=True)
class PaillierScheme:
    """Paillier with generator n + 1; without ``secret`` it can sum but not decrypt."""

    n: int
    secret: tuple[int, int] | None = field(default=None, repr=False)
    name = "paillier"

    @staticmethod
    def generate(bits: int = 1024) -> PaillierScheme:
        while True:
            p, q = _prime(bits // 2), _prime(bits // 2)
            if p != q and math.gcd(p * q, (p - 1) * (q - 1)) == 1:
                return PaillierScheme(p * q, (p, q))

    def public(self) -> PaillierScheme:
        """What may go to executors."""
        return PaillierScheme(self.n)

    def element(self, plain: int) -> int:
        square = self.n * self.n
        return (1 + plain * self.n) % square * pow(secrets.randbelow(self.n - 2) + 1, self.n, square) % square

    def neutral(self) -> int:
        return 1

    def add(self, a: int, b: int) -> int:
        return a * b % (self.n * self.n)

    def times(self, element: int, n: int) -> int:
        return pow(element, n, self.n * self.n)

    def decrypt(self, c: int) -> int:
        if self.secret is None:
            raise ValueError("the public part cannot decrypt")
        p, q = self.secret
        parts = []
        for own, other in ((p, q), (q, p)):
            inverse = pow(-other % own, -1, own)  # of L(g**(own - 1)) mod own
            parts.append((pow(c, own - 1, own * own) - 1) // own * inverse % own)
        return (parts[0] + p * ((parts[1] - parts[0]) * pow(p, -1, q) % q)) % self.n

    def capacity(self) -> int:
        return (self.n.bit_length() - 1) // 8

    def most_chunk_size(self, selectors: int) -> int:
        """All selectors' chunks share a plaintext; 0 if they are too many."""
        return min(384, self.capacity()) // selectors


SCHEMES = {"null": NullScheme, "paillier": PaillierScheme}


def scheme_named(name: str, **settings) -> NullScheme | PaillierScheme:
    """A fresh scheme by its registered name; settings: ``bits`` of the Paillier modulus."""
    if name not in SCHEMES:
        raise ValueError(f"no scheme {name!r}; there are {sorted(SCHEMES)}")
    kind = SCHEMES[name]
    return kind.generate(**settings) if kind is PaillierScheme else kind(**settings)
