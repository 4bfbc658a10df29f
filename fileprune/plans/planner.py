"""Which files are indexed together."""

from __future__ import annotations


def create_batches(sizes: dict[str, dict[str, int]], limit: int) -> list[list[str]]:
    """Batches of files whose largest distinct counts sum up to no more than ``limit``.

    ``sizes``: for each file the distinct values of each column. Files are taken from the largest count down; one above
    the limit is a batch of its own. Files without valued columns are one batch.
    """
    most = {f: max(counts.values(), default=0) for f, counts in sizes.items()}
    if not any(sizes.values()):
        return [sorted(sizes)] if sizes else []
    batches: list[list[str]] = []
    held, total = [], 0
    for name in sorted(most, key=lambda f: (-most[f], f)):
        if most[name] > limit:
            batches.append([name])
        elif held and total + most[name] > limit:
            batches.append(held)
            held, total = [name], most[name]
        else:
            held, total = [*held, name], total + most[name]
    return batches + [held] if held else batches


def byte_batches(sizes: dict[str, int], limit: int) -> list[list[str]]:
    """Files by name in batches of at most ``limit`` bytes; one above the limit is a batch of its own."""
    batches: list[list[str]] = []
    total = 0
    for name in sorted(sizes):
        size = sizes[name] or 0
        if batches and total + size <= limit:
            batches[-1].append(name)
            total += size
        else:
            batches.append([name])
            total = size
    return batches
