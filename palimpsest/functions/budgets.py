"""Prompts and completions within exact token budgets, for Arrow batches.

A text is tokenized once, with the characters that each token stands for; where to cut follows from those places by search, and the cut
is checked on both sides, as a cut word may have other tokens. The tokenizer is a file of the tokenizers library; it must not join
characters across white space.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The system line, how sections begin, how a policy is cited, and the names of what was done.
SYSTEM = "You are a policy-aware enterprise operations agent."
# The first letters as a class of their own, by which a search passes over all else at once.
CURRENT = re.compile(r"(?-i:[RrCcAa])(?:(?<=r)etrieved current policies:|(?<=c)urrent policy(?: clause)?:|(?<=a)ctive policy:)", re.IGNORECASE)
TOOLS = re.compile(r"(?-i:[AaTt])(?:(?<=a)vailable tools:|(?<=t)ool(?: schema:|s:\s*\[|s\s*=\s*\[))", re.IGNORECASE)
EXAMPLES = re.compile(r"\n(?:Optional examples|Examples|Few-shot examples)\s*:\s*\n", re.IGNORECASE)
HISTORY = re.compile(r"\n(?:Policy history|Superseded policies|Older policies|Redundant policy history)\s*:\s*\n", re.IGNORECASE)
CLAUSE = re.compile(r"(?-i:[\[Pp])(?:(?<=\[)[^\]\n]+@[\d.]+\][^\n]*|(?<=p)olicy(?:_id| version)?[^\n]{0,80}(?:effective|version)[^\n]*)", re.IGNORECASE)
ASKS_POLICY, ASKS_TOOLS = "Cite the active policy version", "Use tools as needed"
REMOVED_EXAMPLES, REMOVED_HISTORY, TRIMMED_OLDER, CUT_TAIL = "removed_optional_examples", "removed_policy_history", "trimmed_older_policy_context", "truncated_user_case_tail"
LOST_POLICY, LOST_TOOLS, IDENTICAL = "current_policy_clause_lost", "tool_schema_lost", "chosen_rejected_identical_after_completion_truncation"

PAIR = "prompt string, chosen string, rejected string, prompt_tokens int, chosen_tokens int, rejected_tokens int, first_difference int, survived boolean, policy_kept boolean, tools_kept boolean, warnings array<string>"


class Tokens:
    """Texts as their pieces between white space, each tokenized once: the tokens of a text are those of its pieces, one after the other."""

    PIECE, KEPT, LONG = re.compile(r"[^ \t\n\r]+"), 1 << 17, 64  # so many pieces are kept, longer ones never

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encoded = functools.lru_cache(8)(lambda text: tokenizer.encode(text, add_special_tokens=False))
        self.known: dict[str, tuple[int, ...]] = {}
        # The last few texts are asked for again at once.
        self.count = functools.lru_cache(8)(lambda text: sum(map(len, self.each(self.PIECE.findall(text)))))

    def each(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece; those not yet known are tokenized as one text and told apart by where their tokens begin."""
        if not (new := {*pieces}.difference(self.known)):
            return [self.known[p] for p in pieces]
        if len(self.known) > self.KEPT:
            self.known, new = {}, {*pieces}
        words = [*new]
        ids, ends = self.ids(text := " ".join(words)), np.cumsum([len(p) + 1 for p in words])
        cuts = np.searchsorted(self.places(text)[:, 0], ends).tolist()
        self.known |= {p: tuple(ids[x:y]) for p, x, y in zip(words, [0, *cuts], cuts, strict=False)}
        out = [self.known[p] for p in pieces]
        for p in words:
            if len(p) > self.LONG:
                del self.known[p]
        return out

    def places(self, text: str) -> np.ndarray:
        """(first, behind last) character of each token."""
        return np.array(self.encoded(text).offsets, dtype=np.int64).reshape(-1, 2)

    def ids(self, text: str) -> list[int]:
        return self.encoded(text).ids

    def head(self, text: str, n: int) -> list[tuple[int, int, int]]:
        """(first, behind last character, number of tokens) of text's pieces up to that with token number n + 1, or all if it has no more."""
        out, at, used = [], 0, 0
        while m := self.PIECE.search(text, at):
            # Some pieces at a time, as what comes behind is not asked for.
            end = min(len(text), m.end() + 512)
            at, end = end, m.end() if (m := self.PIECE.match(text, end - 1)) else end
            spans = [x.span() for x in self.PIECE.finditer(text, out[-1][1] if out else 0, end)]
            for (x, y), ids in zip(spans, self.each([text[x:y] for x, y in spans]), strict=True):
                out.append((x, y, len(ids)))
                used += len(ids)
                if used > n:
                    return out
            at = end
        return out

    def end(self, text: str, n: int) -> int:
        """Behind the last character of token number n, which text has."""
        head = self.head(text, n - 1)
        x, y, k = head[-1]
        return x + int(self.places(text[x:y])[n - 1 - sum(k for _, _, k in head[:-1]), 1])


def without(text: str, section: re.Pattern) -> str:
    """text without a section: from its mark to the next mark of any section."""
    if not (mark := section.search(text)):
        return text
    later = [m.start() for m in (s.search(text, mark.end()) for s in (CURRENT, TOOLS, EXAMPLES, HISTORY)) if m]
    return (text[: mark.start()] + text[min(later) :]).strip() if later else text[: mark.start()].rstrip()


def without_older(text: str) -> str:
    """text with only the first of the policies in force that are listed: of a long list the first, of a short one all but what is superseded."""
    mark = CURRENT.search(text)
    listed = re.split(r"\n(?=\[)", text[mark.end() :]) if mark else []
    if len(listed) < 2:
        return without(text, HISTORY)
    old = lambda x: "supersed" in x.lower() or "history" in x.lower()
    rest = [] if len(text) - mark.end() > 800 else [x for x in listed[1:] if not old(x)]
    return (text[: mark.end()] + listed[0] + "".join(rest)).rstrip()


def names_policy(text: str) -> bool:
    return bool(CURRENT.search(text)) or ASKS_POLICY in text or bool(CLAUSE.search(text))


def names_tools(text: str) -> bool:
    return bool(TOOLS.search(text)) or ASKS_TOOLS in text


@dataclass
class Tail:
    """A prompt whose body may be cut at its end, between its system line and what is kept behind."""

    system: str
    body: str
    kept: str

    @classmethod
    def of(cls, text: str) -> Tail:
        bare = text.strip()
        body = bare[len(SYSTEM) :].lstrip() if bare.startswith(SYSTEM) else text
        mark = CURRENT.search(body) or TOOLS.search(body)
        return cls(SYSTEM, body[: mark.start()].rstrip(), body[mark.start() :]) if mark else cls(SYSTEM, body, "")

    def at(self, n: int) -> str:
        return "\n".join(p for p in (self.system, self.body[:n], self.kept) if p).strip()

    def longest(self, tokens: Tokens, most: int) -> str | None:
        """The prompt with as much of the body as fits, to the character; None if not even none of it does."""
        fits = lambda n: tokens.count(self.at(n)) <= most
        room = most - tokens.count(self.at(0))
        if room < 0:
            return None
        head = tokens.head(self.body, room)
        words, upto = np.array([h[:2] for h in head], dtype=np.int64).reshape(-1, 2), np.cumsum([h[2] for h in head])  # tokens up to each word's end
        whole = int(np.searchsorted(upto, room, side="right"))
        n = len(self.body)
        if whole < len(words):
            n, used = int(words[whole, 0]), int(upto[whole - 1]) if whole else 0
            word = self.body[n : int(words[whole, 1])]
            n += next((k for k in range(len(word) - 1, 0, -1) if used + tokens.count(word[:k]) <= room), 0)
        while n and not fits(n):
            n -= 1
        while n < len(self.body) and fits(n + 1):
            n += 1
        return self.at(n)


def fit_prompt(text: str, tokens: Tokens, most: int) -> tuple[str, list[str]]:
    """A prompt of at most `most` tokens and what was done: examples go, then the policy history, then older policies, then the case's tail."""
    said: list[str] = []
    if tokens.count(text) <= most:
        return text, said
    policy, tools = names_policy(text), names_tools(text)
    for name, step in ((REMOVED_EXAMPLES, lambda x: without(x, EXAMPLES)), (REMOVED_HISTORY, lambda x: without(x, HISTORY)), (TRIMMED_OLDER, without_older)):
        less = step(text)
        if less != text:
            text = less
            said.append(name)
            if tokens.count(text) <= most:
                return text, said
    tail = Tail.of(text)
    text = tail.longest(tokens, most) or tail.body
    said.append(CUT_TAIL)
    said += [LOST_POLICY] if policy and not names_policy(text) else []
    said += [LOST_TOOLS] if tools and not names_tools(text) else []
    return text, said


def first_tokens(text: str, tokens: Tokens, most: int) -> str:
    """text up to the end of its token number `most`, stripped; a token less as long as what is left has more tokens."""
    if tokens.count(text) <= most:
        return text
    while most and tokens.count(cut := text[: tokens.end(text, most)].strip()) > most:
        most -= 1
    return cut if most else ""


@dataclass
class Budget:
    total: int = 512
    prompt: int = 384
    completion: int = 128
    tokenizer: str = field(default="")

    def __post_init__(self) -> None:
        if self.prompt + self.completion > self.total:
            raise ValueError("prompt and completion exceed the total")


def fit_pair(prompt: str, chosen: str, rejected: str, tokens: Tokens, budget: Budget) -> tuple:
    """A row of PAIR: room for completions is kept first, the prompt shrinks into the rest."""
    most = min(budget.prompt, budget.total - budget.completion)
    text, said = fit_prompt(prompt, tokens, most)
    if (n := tokens.count(text)) > most:
        said.append(f"prompt_hard_trim:{n}->{most}")
        text = first_tokens(text, tokens, most)
    sides = []
    for name, side in (("chosen", chosen), ("rejected", rejected)):
        if (n := tokens.count(side)) > budget.completion:
            said.append(f"{name}_completion_truncated_from_end:{n}->{budget.completion}")
            side = first_tokens(side, tokens, budget.completion)
        sides.append((side, [*itertools.chain(*tokens.each(tokens.PIECE.findall(side)))]))
    (a, x), (b, y) = sides
    if x and x == y:
        said.append(IDENTICAL)
    differs = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)) if len(x) != len(y) else None)
    return text, a, b, tokens.count(text), len(x), len(y), differs, x != y, names_policy(text), names_tools(text), said


def fit_pairs(pairs: DataFrame, key: str, budget: Budget) -> DataFrame:
    """key and PAIR for each row of pairs (key, prompt, chosen, rejected); null texts count as empty."""
    from palimpsest.operators.frames import importable

    names = [x.split()[0] for x in PAIR.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(budget.tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [fit_pair(*(x or "" for x in r), tokens, budget) for r in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, kinds[x.split()[1]]) for c, x in zip(cols, PAIR.split(", "), strict=True))], names=[key, *names])

    importable(pairs.sparkSession)
    return pairs.select(key, "prompt", "chosen", "rejected").mapInArrow(run, f"{key} {dict(pairs.dtypes)[key]}, {PAIR}")


def report(fitted: DataFrame, least_percent: float = 95.0) -> DataFrame:
    """Per token column (prompt, the completions, and of these what the loss sees; the first difference) least, mean and most; and of all pairs n, percent that still
    differ, pairs without any loss token, warnings by kind (text before a colon), and whether the gate is passed.
    """
    cols = {"prompt": "prompt_tokens", "chosen_completion": "chosen_tokens", "rejected_completion": "rejected_tokens", "chosen_loss": "chosen_tokens", "rejected_loss": "rejected_tokens", "first_difference": "first_difference"}
    # Pairs are grouped by their kinds of warnings first, of which there are few sets, so that each pair is fitted once.
    kinds = F.coalesce(F.array_sort(F.transform("warnings", lambda x: F.substring_index(x, ":", 1))), F.array().cast("array<string>"))
    parts = fitted.groupBy(kinds.alias("kinds")).agg(
        *(f(c).alias(f"{n}_{f.__name__}") for n, c in cols.items() for f in (F.min, F.sum, F.count, F.max)), F.count(F.lit(1)).alias("n"), F.count_if("survived").alias("survived"),
        F.count_if((F.col("chosen_tokens") == 0) | (F.col("rejected_tokens") == 0)).alias("empty"))
    sums = parts.agg(
        *(F.min(f"{n}_min").alias(f"{n}_min") for n in cols), *((F.sum(f"{n}_sum") / F.sum(f"{n}_count")).alias(f"{n}_avg") for n in cols), *(F.max(f"{n}_max").alias(f"{n}_max") for n in cols),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n", "survived", "empty")), F.collect_list(F.struct("kinds", "n")).alias("sets"))
    lengths = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_min").cast("double").alias("least"), F.col(f"{n}_avg").alias("mean"), F.col(f"{n}_max").cast("double").alias("most")) for n in cols])
    percent = F.when(F.col("n") > 0, 100.0 * F.col("survived") / F.col("n")).otherwise(0.0)
    names = F.array_sort(F.array_distinct(F.flatten("sets.kinds")))
    often = lambda k: F.aggregate("sets", F.lit(0).cast("long"), lambda n, x: n + x["n"] * F.size(F.filter(x["kinds"], lambda y: y == k)))
    said = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("w"), F.coalesce(often(k), F.lit(0)).alias("n"))))
    return sums.select("n", percent.alias("percent"), "empty", said.alias("warnings"), lengths.alias("lengths"), ((F.col("n") > 0) & (percent >= least_percent) & (F.col("empty") == 0)).alias("passed"))
