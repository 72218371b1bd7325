"""Secret scan over a trigram inverted index, with DataFrame functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, values, with_row_key, with_running_ends


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int
    least: int


#: The patterns and least lengths of the three kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Strings that a part of a pattern is expanded to at most; beyond it the part is taken to match anything.
EXPANSIONS = 64


def exact_strings(tokens) -> set[str] | None:
    """All lower-cased strings that a parsed pattern matches, None if unbounded or too many."""
    out = {""}
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            step = {chr(arg).lower()}
        elif name == "SUBPATTERN":
            step = exact_strings(arg[3])
        elif name == "BRANCH":
            parts = [exact_strings(x) for x in arg[1]]
            step = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] <= 2:
            one = exact_strings(arg[2])
            step = None if one is None else {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(one, repeat=n)}
        else:
            step = None
        if step is None or len(out) * len(step) > EXPANSIONS:
            return None
        out = {a + b for a in out for b in step}
    return out


def trigram_query(pattern: str) -> list[set[str]]:
    """An OR of ANDs of lower-cased trigrams that every match of the pattern implies.

    Runs of exactly known strings in the pattern's top-level sequence each
    give one query; the conjunction of all is multiplied out. An empty list
    means that no trigram is mandatory.
    """
    runs: list[list[set[str]]] = []
    held: list = []

    def close() -> None:
        if held and (strings := exact_strings(held)):
            clauses = [{s[i : i + 3] for i in range(len(s) - 2)} for s in strings]
            if all(clauses):
                runs.append(clauses)
        held.clear()

    tokens = list(regex_parser.parse(pattern))
    for token in tokens:
        if exact_strings([token]) is None or exact_strings([*held, token]) is None:
            close()
        if exact_strings([token]) is not None:
            held.append(token)
    close()
    if not runs:
        return []
    clauses = [set().union(*c) for c in itertools.product(*runs)]
    return [c for c in clauses if not any(d < c for d in clauses)]


def postings(docs: DataFrame, trigrams: list[str], text: str) -> DataFrame:
    """The inverted index ``(trigram, _sw_k1, _sw_k2)`` over the trigrams that occur in any query."""
    low = F.lower(text_of(text))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("_sw_low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.withColumn("_sw_low", low).select(F.explode_outer(found).alias("trigram"), "_sw_k1", "_sw_k2").where("trigram is not null")


def candidates(index: DataFrame, queries: dict[str, list[set[str]]]) -> DataFrame:
    """Intersects postings: ``(_sw_k1, _sw_k2, _sw_kinds)`` for documents that satisfy a clause of a rule."""
    clauses = [
        (kind, n, len(c), t) for kind, clauses in queries.items() for n, c in enumerate(clauses) for t in sorted(c)
    ]
    wanted = values(index.sparkSession, "kind string,clause int,needs int,trigram string", clauses)
    return (
        index.dropDuplicates(["trigram", "_sw_k1", "_sw_k2"])
        .join(F.broadcast(wanted), "trigram")
        .groupBy("_sw_k1", "_sw_k2", "kind", "clause", "needs")
        .count()
        .where("count = needs")
        .groupBy("_sw_k1", "_sw_k2")
        .agg(F.collect_set("kind").alias("_sw_kinds"))
    )


def with_matches(df: DataFrame, body: Column, rules: tuple[Rule, ...], admitted: list[Column]) -> DataFrame:
    """Adds ``_sw_s0, ...``: per rule, spans of the leftmost non-overlapping matches, null where none is tried.

    The pieces between the matches and the matches themselves tile the text,
    so running sums of their lengths are the positions, in code points.
    """
    long_of = lambda x: F.char_length(x).cast("long")
    names = [f"_sw_e{i}" for i in range(len(rules))]
    for i, (r, a) in enumerate(zip(rules, admitted, strict=True)):
        pattern = F.lit(r.pattern)
        lengths = lambda g: F.transform(F.regexp_extract_all(body, pattern, F.lit(g)), long_of)  # noqa: B023, E731
        gaps = F.transform(F.split(body, r.pattern, -1), long_of)
        df = df.withColumn(f"_sw_a{i}", a)
        df = df.withColumns({f"_sw_{n}{i}": F.when(F.col(f"_sw_a{i}"), x) for n, x in (("l", lengths(0)), ("v", lengths(r.group)), ("g", gaps))})
        # the piece after the last match has no match of its own
        tiles = F.zip_with(F.slice(f"_sw_g{i}", F.lit(1), F.size(f"_sw_l{i}")), f"_sw_l{i}", lambda g, n: g + n)
        df = df.withColumn(f"_sw_e{i}", F.when(F.col(f"_sw_a{i}"), tiles))
    df = with_running_ends(df, names)
    for i, r in enumerate(rules):
        valued = F.zip_with(f"_sw_e{i}", f"_sw_v{i}", lambda e, v: F.struct(e.alias("e"), (v >= r.least).alias("ok")))
        spans = F.zip_with(
            valued,
            f"_sw_l{i}",
            lambda x, n: F.struct((x["e"] - n).alias("start"), F.lit(i).alias("kind"), x["e"].alias("end"), x["ok"].alias("ok")),
        )
        df = df.withColumn(f"_sw_s{i}", F.filter(spans, lambda s: s["ok"]))
    return df.drop(*[f"_sw_{n}{i}" for n in "alvge" for i in range(len(rules))])


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Finds secrets: trigram postings choose the documents, the regexes verify them.

    Every rule's regex is turned into a Boolean query over trigrams. The
    postings of all those trigrams are intersected per document, and a rule
    runs only over documents that its query admits; rules without a mandatory
    trigram run over every document. A rule first tests a document with one
    pass that builds nothing; positions are worked out where it matches.

    Returns the input columns plus ``spans``, an array of structs ``(start,
    kind, end, name)`` sorted by start and then by the order of ``rules``;
    positions are code points, the end exclusive. Defined cases: null text is
    empty and has no spans; repeated rows each get their spans; a clashing
    ``spans`` column is replaced; an empty table gives an empty result.

    Postings are joined and grouped by document, never by trigram, so frequent
    trigrams make no hot key. Texts are shuffled once.
    """
    base = with_row_key(docs, doc_id, text)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    if queries:
        base = base.join(candidates(postings(base, trigrams, text), queries), ["_sw_k1", "_sw_k2"], "left")
    else:
        base = base.withColumn("_sw_kinds", F.array().cast("array<string>"))
    body = text_of(text)
    kinds = F.coalesce("_sw_kinds", F.array().cast("array<string>"))
    admitted = []
    for r in rules:
        # the short form of an unindexed character run never matches less often
        run = r.kind not in queries and r.group == 0 and r.pattern.endswith("]+") and r.pattern.startswith("[")
        test = body.rlike(f"{r.pattern[:-1]}{{{r.least}}}" if run else r.pattern)
        admitted.append(F.array_contains(kinds, r.kind) & test if r.kind in queries else test)
    base = with_matches(base, body, rules, admitted)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,ok:boolean>>")
    found = [F.coalesce(F.col(f"_sw_s{i}"), none) for i in range(len(rules))]
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(
        F.array_sort(F.concat(*found)),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.get(names, s["kind"]).alias("name")),
    )
    return base.withColumn("spans", spans).drop("_sw_k1", "_sw_k2", "_sw_kinds", *[f"_sw_s{i}" for i in range(len(rules))])
