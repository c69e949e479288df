"""License scans by template markup.

A template is license wording with marked regions:

- ``<<optional>> words <</optional>>`` may be present as a whole or absent, and may be nested;
- ``<<any N-M>>`` stands for N to M words of any kind (a name, a year, a version).

Everything else is mandatory wording and must match word for word. Templates are compiled into token
automata; a text is accepted where some run of its words leads from the first state to the last."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MARK = re.compile(r"<<(optional|/optional|any (\d+)-(\d+))>>")

# The phrases of the base scan and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and notices, with the markup above.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 <<optional>>the license<</optional>>",
    "apache-2.0-url": "apache license <<optional>>version<</optional>> 2 0 <<optional>>january 2004<</optional>> <<optional>>http<</optional>> www apache org licenses",
    "mit-notice": "<<optional>>this <<any 1-3>> is<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "gpl-3.0-notice": "<<optional>>this <<any 1-3>> is<</optional>> licensed under the gnu general public license version 3 <<optional>>or <<optional>>at your option<</optional>> any later version<</optional>>",
    "gpl-2.0-notice": "licensed under the gnu general public license version 2 <<optional>>or <<optional>>at your option<</optional>> any later version<</optional>>",
    "gpl-any-text": "you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<</optional>> general public license as published by the free software foundation either version <<any 1-2>> of the license or at your option any later version",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by nc 4 0 <<optional>>international license<</optional>>",
    "cc-by-4.0": "licensed under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> cc by 4 0 <<optional>>international license<</optional>>",
}


def words_of(text: str | None) -> list[str]:
    """Words after lower-casing A-Z; a null text has none."""
    return WORD.findall((text or "").translate(LOWER))


@dataclass
class Automaton:
    """States 0 to n-1 over words: ``moves[s]`` by word, ``free[s]`` by any word, ``jumps[s]`` by none."""

    moves: list[dict[str, list[int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    jumps: list[list[int]] = field(default_factory=list)
    last: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.free.append([])
        self.jumps.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.jumps[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def first_words(self) -> set[str]:
        """Words that a match can begin with. A template may not begin with words of any kind."""
        start = self.closure({0})
        if any(self.free[s] for s in start) or self.last in start:
            raise ValueError("a template begins with mandatory or optional wording and is not empty")
        return {w for s in start for w in self.moves[s]}

    def longest(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at ``at``, -1 if there is none."""
        now, end, i = self.closure({0}), -1, at
        while now and i < len(words):
            step: set[int] = set()
            for s in now:
                step.update(self.moves[s].get(words[i], ()))
                step.update(self.free[s])
            now, i = self.closure(step), i + 1
            if self.last in now:
                end = i
        return end


def compile_template(template: str) -> Automaton:
    made = Automaton()
    here, opened, at = made.state(), [], 0
    for mark in [*MARK.finditer(template), None]:
        for word in words_of(template[at:mark.start() if mark else None]):
            there = made.state()
            made.moves[here].setdefault(word, []).append(there)
            here = there
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "optional":
            opened.append(here)
        elif mark[1] == "/optional":
            if not opened:
                raise ValueError("a region is closed that is not open")
            made.jumps[opened.pop()].append(here)
        else:
            least, most = int(mark[2]), int(mark[3])
            begin = here
            ends = [here] if least == 0 else []
            for k in range(1, most + 1):
                there = made.state()
                made.free[here].append(there)
                here = there
                if k >= least:
                    ends.append(here)
            if most < least or begin == here:
                raise ValueError("a region of any words has room for one at least")
            for s in ends[:-1]:
                made.jumps[s].append(here)
    if opened:
        raise ValueError("a region stays open")
    made.last = here
    return made


class Scanner:
    """Compiled templates and phrases, found through the words that they can begin with."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.starts: dict[str, list[tuple[str, Automaton]]] = {}
        for label, template in templates.items():
            made = compile_template(template)
            for word in made.first_words():
                self.starts.setdefault(word, []).append((label, made))
        self.phrases: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for phrase, label in phrases.items():
            key = tuple(words_of(phrase))
            self.phrases.setdefault(key[0], []).append((key, label))
        heads = sorted({*self.starts, *self.phrases}, key=len, reverse=True)
        #: One pass over the text finds the places where anything can begin; most texts have few.
        self.heads = set(heads)

    def base(self, words: list[str], places: list[int]) -> list[tuple[int, str]]:
        return [(i, label) for i in places for key, label in self.phrases.get(words[i], ()) if tuple(words[i:i + len(key)]) == key]

    def accepted(self, words: list[str], places: list[int]) -> list[tuple[str, int, int]]:
        """(label, start, end) of the longest match at each place where a template matches."""
        return [(label, i, end) for i in places for label, made in self.starts.get(words[i], ()) if (end := made.longest(words, i)) >= 0]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Base phrases and accepted license templates in every whole text.

    Returns id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, null if none), base_labels, labels (base labels and accepted templates; distinct,
    sorted, comma-joined), spans ("label:start-end" of accepted templates, in text order) and score: 1 if a
    template is accepted, 0.5 if only base phrases are there, else 0. A null or empty text has no words and
    score 0; repeated ids give repeated rows; other columns are not read. One pass, no shuffle."""
    scanner_parts = (TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(*scanner_parts)
        for batch in batches:
            rows = []
            for key, text in zip(batch["k"], batch["t"]):
                words = words_of(text)
                places = [i for i, w in enumerate(words) if w in scanner.heads]
                base, found = scanner.base(words, places), scanner.accepted(words, places)
                labels = {label for _, label in base}
                rows.append((
                    key, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)),
                    ",".join(sorted(labels | {x[0] for x in found})), ";".join(f"{x}:{i}-{j}" for x, i, j in found),
                    1.0 if found else 0.5 if base else 0.0,
                ))
            out = pd.DataFrame(rows, columns=["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"])
            out["k"] = batch["k"].to_numpy()
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    # ids go through pandas as text, which has room for a null beside large numbers
    found = docs.select(docs[id_col].cast("string").alias("k"), docs[text_col].alias("t")).mapInPandas(
        scan, "k string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, spans string, score double")
    return found.withColumn("k", F.col("k").cast(docs.schema[id_col].dataType)).withColumnRenamed("k", id_col)
