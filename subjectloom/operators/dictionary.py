"""Which names of a dictionary a text contains, by one automaton for all names.

The automaton (Aho and Corasick, 1975) reads a text once, whatever the number of names.  Names are
shipped with the tasks, so the dictionary's size is checked: a larger one is scanned in parts, each
with an automaton of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of names in one automaton (some 100 bytes of memory each).
LARGEST = 4_000_000


def parts_of(names: Sequence[str], largest: int = LARGEST) -> list[list[tuple[int, str]]]:
    """Places and names in parts of at most ``largest`` characters (one name at least)."""
    out: list[list[tuple[int, str]]] = []
    size = 0
    for place, name in enumerate(names):
        if not out or size + len(name) > largest:
            out.append([])
            size = 0
        out[-1].append((place, name))
        size += len(name)
    return out


def names_in(rows: DataFrame, text: str, out: str, names: Sequence[str], variants: Mapping[str, str] | None = None, largest: int = LARGEST) -> DataFrame:
    """``rows`` with ``out``: the canonical forms of the names that the column ``text`` contains, each once, in
    the order of the dictionary; ``variants`` maps spellings to canonical forms.  A null text gives null, an
    empty name is in every text."""
    canonical = [(variants or {}).get(n, n) for n in names]
    parts = parts_of(names, largest)
    at = rows.columns.index(text)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automata, always = [], [i for i, n in enumerate(names) if not n]
        for part in parts:
            places: dict[str, list[int]] = {}
            for place, name in part:
                if name:
                    places.setdefault(name, []).append(place)
            automaton = ahocorasick.Automaton()
            for name, own in places.items():
                automaton.add_word(name, own)
            if places:
                automaton.make_automaton()
                automata.append(automaton)
        for batch in batches:
            found = []
            for said in batch.column(at).to_pylist():
                if said is None:
                    found.append(None)
                    continue
                met = set(always)
                for automaton in automata:
                    for _, own in automaton.iter(said):
                        met.update(own)
                found.append(list(dict.fromkeys(canonical[i] for i in sorted(met))))
            yield batch.append_column(out, pa.array(found, pa.list_(pa.string())))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scan, f"{fields}, `{out}` array<string>")
