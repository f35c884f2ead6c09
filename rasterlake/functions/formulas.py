"""Closed-form scores as SQL text for ``expr``. The oracle has formulas of its own.

Counts and sums go in, a score comes out. NULL stands for a score that is not defined.
"""

EPS = "2.220446049250313E-16"


def f_score(p: str, r: str, beta: str = "0.3E0") -> str:
    """F with the weight used as it is (not squared); 0 where the product is 0."""
    return f"(CASE WHEN ({p}) * ({r}) = 0 THEN 0E0 ELSE (1 + {beta}) * ({p}) * ({r}) / ({beta} * ({p}) + ({r})) END)"


def enhanced_alignment(tp: str, ps: str, f: str, n: str) -> str:
    """E-measure of a binary prediction with ``ps`` positives, ``tp`` of them true, of ``f`` positives among ``n`` pixels."""

    def part(a: str, c: str) -> str:
        return f"power(2 * ({a}) * ({c}) / (power({a}, 2) + power({c}, 2) + {EPS}) + 1, 2) / 4"

    mp, mg = f"({ps} / CAST({n} AS DOUBLE))", f"({f} / CAST({n} AS DOUBLE))"
    mixed = (
        f"{part(f'1 - {mp}', f'1 - {mg}')} * {tp} + {part(f'1 - {mp}', f'-{mg}')} * ({ps} - {tp})"
        f" + {part(f'-{mp}', f'1 - {mg}')} * ({f} - {tp}) + {part(f'-{mp}', f'-{mg}')} * ({n} - {ps} - {f} + {tp})"
    )
    return f"((CASE WHEN {f} = 0 THEN CAST({n} - {ps} AS DOUBLE) WHEN {f} = {n} THEN CAST({ps} AS DOUBLE) ELSE {mixed} END) / ({n} - 1 + {EPS}))"
