"""Variant spellings of names: a symmetric-delete index on tokens, and alignment of tokens by optimal assignment.

1. Names become forms: folded tokens, generational suffix apart, titles and particles dropped. Equal forms are one.
2. Symmetric-delete neighbourhood: two tokens within one edit (two, for long ones) share a string left by deleting
   letters of either. An equality join on those strings finds the neighbours; a rare spelling takes the commonest.
3. Forms that share any two corrected tokens and the suffix meet in a block. The rest of their tokens is aligned by
   optimal assignment; initials, abbreviations, nicknames and typing errors may pair. A form with little left
   (initials only) joins only where exactly one name of the block fits. Names without two long tokens meet where all
   tokens but one are equal and that one is a typing error.
4. Links are stars, never all pairs of a block; entities are their connected components.

A hot name is one form however many rows it has, so blocks grow with distinct spellings, not with rows. A block of
many forms is split by the letters that two tokens which may pair share at their beginning, so that its size changes
the cost and not the links (but for forms that fit several names equally well).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabularium.session import small, stage, unstage

#: Words of a name that don't tell persons apart, and generational suffixes by class.
TITLES = frozenset("dr dra doutor doutora sr sra senhor senhora prof profa professor professora ver exmo exma exmos eng enga adv des dep sen ilmo ilma".split())
NICK = frozenset("ze seu dona nene tio tia mano".split())
PARTICLES = frozenset("de da do dos das di du del".split())
SUFFIXES = {"filho": "filho", "fo": "filho", "neto": "neto", "nto": "neto", "junior": "junior", "jr": "junior", "jnr": "junior", "sobrinho": "sobrinho"}
_LEET = str.maketrans("013457", "oieast")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])")
_TOKEN = re.compile(r"[a-z]+")


def fold(text: str) -> str:
    text = re.sub("[­​-‍⁠﻿]", "", text)
    text = re.sub(r"\b([FfNn])\s*\.?\s*[º°]", lambda m: " filho " if m.group(1) in "Ff" else " neto ", text)
    text = unicodedata.normalize("NFD", _CAMEL.sub(" ", text) if not text.isupper() else text)
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("º", "").replace("ª", "")
    return re.sub(r"(?<=[a-z])[0-9](?=[a-z])|\b[0-9](?=[a-z]{2})|(?<=[a-z]{2})[0-9]\b", lambda m: m.group(0).translate(_LEET), text)


def form(name: str | None) -> tuple[list[str], str]:
    """(tokens, suffix class) of a name; empty for null and letterless names."""
    if not name:
        return [], ""
    text = fold(name)
    if text.count(",") == 1:
        a, b = text.split(",")
        if _TOKEN.search(a) and _TOKEN.search(b):
            text = b + " " + a
    tokens, suffix = [], ""
    for n, m in enumerate(_TOKEN.finditer(text)):
        t = m.group(0)
        dotted = text[m.end() : m.end() + 1] == "."
        if t in SUFFIXES and n:
            suffix = SUFFIXES[t]
        elif t in TITLES or t in NICK or t in PARTICLES or (t == "e" and n and not dotted):
            continue
        else:
            tokens.append(t)
    return tokens, suffix


@lru_cache(maxsize=100_000)
def edits(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (swaps of neighbours cost one)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 9
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def stem(token: str) -> str | None:
    """What a nickname keeps of a name: 'gigi' -> 'gi', 'fabrinho' -> 'fabr', 'adalao' -> 'adal'; null for other tokens."""
    if len(token) % 2 == 0 and len(token) <= 8 and token[: len(token) // 2] == token[len(token) // 2 :]:
        return token[: len(token) // 2]
    m = re.fullmatch(r"([a-z]{3,6}?)(?:z?inh[oa]|ao|it[oa]|uxo)", token)
    return m.group(1) if m else None


def cost(a: str, b: str) -> float:
    """Cost of pairing two tokens: 0 equal, small for typing errors, more for initials, abbreviations and nicknames; 9 if they don't pair."""
    if a == b:
        return 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) <= 3 and long_.startswith(short):
        return 0.5
    if len(short) >= 4 and (d := edits(a, b)) <= (1 if len(short) < 8 else 2):
        return 0.2 * d
    if 3 <= len(short) <= 6 and len(long_) >= len(short) + 2 and long_.startswith(short):
        return 0.5
    for nick, full in ((a, b), (b, a)):
        s = stem(nick)
        if s and len(full) > len(s) and full.startswith(s):
            return 0.6
    return 9.0


def optimal(costs: list[list[float]]) -> list[int]:
    """The column of each row in the assignment of least total cost, for a matrix with at least as many columns as rows.

    Shortest augmenting paths with potentials (the Hungarian method); exact for every size.
    """
    rows, cols = len(costs), len(costs[0]) if costs else 0
    u, v, owner = [0.0] * rows, [0.0] * cols, [-1] * cols
    for r in range(rows):
        reach, before, done = [float("inf")] * cols, [-1] * cols, [False] * cols
        row, last = r, -1
        while row >= 0:
            best, at = float("inf"), -1
            for c in range(cols):
                if not done[c]:
                    new = costs[row][c] - u[row] - v[c] + (reach[last] if last >= 0 else 0.0)
                    if new < reach[c] - 1e-12:
                        reach[c], before[c] = new, last
                    if reach[c] < best:
                        best, at = reach[c], c
            done[at] = True
            row, last = owner[at], at
        for c in range(cols):
            if done[c] and c != last:
                v[c] += reach[c] - reach[last]
                u[owner[c]] += reach[last] - reach[c]
        u[r] += reach[last]
        while last >= 0:
            owner[last] = owner[before[last]] if before[last] >= 0 else r
            last = before[last]
    out = [0] * rows
    for c, r in enumerate(owner):
        if r >= 0:
            out[r] = c
    return out


def assign(left: list[str], right: list[str]) -> tuple[float, list[str], list[str]]:
    """(cost, unmatched of left, unmatched of right) of the best assignment: as many pairs as possible, then the least cost."""
    if len(left) > len(right):
        c, r, l = assign(right, left)
        return c, l, r
    if not left:
        return 0.0, [], list(right)
    costs = [[cost(a, b) for b in right] for a in left]
    chosen = optimal([[x if x < 9 else 1000.0 for x in row] for row in costs])
    pairs = [(i, j) for i, j in enumerate(chosen) if costs[i][j] < 9]
    used, taken = {i for i, _ in pairs}, {j for _, j in pairs}
    return sum(costs[i][j] for i, j in pairs), [a for i, a in enumerate(left) if i not in used], [b for j, b in enumerate(right) if j not in taken]


def _strong(tokens: list[str]) -> list[str]:
    return [t for t in tokens if len(t) >= 4 and not (len(t) <= 8 and len(t) % 2 == 0 and t[: len(t) // 2] == t[len(t) // 2 :])]


def same(a: list[str], b: list[str], whole_a: list[str], whole_b: list[str]) -> bool:
    """Whether the rests a and b of two full names fit: all of the shorter pairs, and what is left over is an acronym of the name."""

    def acronym(t: str, own: list[str]) -> bool:
        return len(t) <= 4 and any(t == "".join(x[0] for x in own[i : i + len(t)]) for i in range(len(own)))

    _, left, right = assign(a, b)
    return all(acronym(t, [x for x in whole_a if x != t]) for t in left) and all(acronym(t, [x for x in whole_b if x != t]) for t in right)


def link_block(t1: str, t2: str, forms: list[tuple[str, list[str], bool]]) -> list[tuple[str, str]]:
    """Star links (form, form) of a block whose forms all hold t1 and t2; forms: (key, tokens, is a probe). Probes link to others only."""
    full, partial = [], []
    for key, tokens, probe in sorted(forms, key=lambda x: (x[2], -len(x[1]), x[0])):
        rest = list(tokens)
        rest.remove(t1)
        if t2 in rest:
            rest.remove(t2)
        strong = [t for t in _strong(rest) if not stem(t)]
        (full if strong else partial).append((key, tokens, rest, probe))
    links: list[tuple[str, str]] = []
    clusters: list[list] = []  # of (key, tokens, rest); probes never found one
    for key, tokens, rest, probe in full:
        fits = [c for c in clusters if any(same(rest, r, tokens, w) for _, w, r in c)]
        if fits:
            fits.sort(key=lambda c: min(assign(rest, r)[0] for _, w, r in c))
            links.append((key, fits[0][0][0]))
            if not probe and all(r != rest for _, _, r in fits[0]):  # equal rests compare alike
                fits[0].append((key, tokens, rest))
        elif not probe:
            clusters.append([(key, tokens, rest)])
    loose: list[list] = []
    for key, tokens, rest, probe in partial:
        fits = [c for c in clusters if not assign(rest, c[0][2])[1] or any(not assign(rest, r)[1] for _, _, r in c)]
        if len(fits) == 1:
            links.append((key, fits[0][0][0]))
        elif not fits and not clusters:
            own = [c for c in loose if assign(rest, c[0][2])[1] == [] or assign(rest, c[0][2])[2] == []]
            if len(own) == 1:
                links.append((key, own[0][0][0]))
            elif not probe and not own:
                loose.append([(key, tokens, rest)])
    return links


def forms_of(df: DataFrame, column: str) -> DataFrame:
    """(texto, tokens, sufixo) of each distinct non-null text of column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [form(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in made], pa.list_(pa.string())), pa.array([s for _, s in made], pa.string())], names=["texto", "tokens", "sufixo"])

    return df.select(F.col(column).alias("texto")).filter("texto IS NOT NULL").distinct().mapInArrow(run, "texto string, tokens array<string>, sufixo string")


def deletions(token: F.Column, two: bool = True) -> F.Column:
    """A token and what is left of it without one letter, or (with two) two where it has eight or more: the symmetric-delete index."""

    def one(t: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    first = one(token)
    if not two:
        return F.array_distinct(F.concat(F.array(token), first))
    second = F.when(F.length(token) >= 8, F.flatten(F.transform(first, one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(token), first, second))


def neighbours(probes: DataFrame, references: DataFrame, two: bool = True) -> DataFrame:
    """(token, ref, d) for tokens of probes and references (both: token) within one edit, or (with two) two for eight letters or more."""
    a = probes.filter("length(token) >= 4").select("token", F.explode(deletions(F.col("token"), two)).alias("resto"))
    b = references.filter("length(token) >= 4").select(F.col("token").alias("ref"), F.explode(deletions(F.col("token"), two)).alias("resto"))
    # a swap is two plain edits: the built-in distance leaves few pairs to look at
    pairs = a.join(b, "resto").filter(f"token <> ref AND levenshtein(token, ref, {4 if two else 2}) >= 0").select("token", "ref").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([edits(p, q) for p, q in zip(x, y)], pa.int32())], names=["token", "ref", "d"])

    near = pairs.mapInArrow(run, "token string, ref string, d int")
    return near.filter("d <= CASE WHEN least(length(token), length(ref)) < 8 THEN 1 ELSE 2 END")


def corrections(tokens: DataFrame, references: DataFrame, own: bool) -> DataFrame:
    """(token, certo, partes): the reference token each token stands for, itself included; a run-together token gives both parts.

    tokens and references are (token, n): in how many texts a token occurs. Among a table's own tokens a clearly rarer spelling gives way, by one edit. In other texts a
    spelling is no typing error of a token that those texts hold clearly less often.
    """
    near = neighbours(tokens, references, two=not own).join(tokens, "token").join(references.select(F.col("token").alias("ref"), F.col("n").alias("m")), "ref")
    if own:
        near = near.filter("d = 1 AND (n <= 3 AND m >= 2 * n OR m >= 8 * n OR m = 1 AND n = 1 AND length(token) >= 7 AND ref < token)")
    else:
        near = near.join(tokens.select(F.col("token").alias("ref"), F.col("n").alias("k")), "ref", "left").filter("n <= coalesce(k, 0) + CASE d WHEN 1 THEN 5 ELSE 3 END")
    best = near.groupBy("token").agg(F.min_by("ref", F.struct("d", (-F.col("m")).alias("m"), "ref")).alias("ref"))
    known = references.select(F.col("token").alias("k"))
    splits = tokens.filter("length(token) >= 10" + (" AND n <= 2" if own else "")).select("token", F.explode(F.sequence(F.lit(4), F.length("token") - 4)).alias("i"))
    halves = splits.select("token", F.expr("left(token, i)").alias("e"), F.expr("substring(token, i + 1)").alias("d"))
    halves = halves.join(known, halves["e"] == known["k"]).drop("k").join(known, F.col("d") == F.col("k")).groupBy("token").agg(F.min(F.array("e", "d")).alias("partes"))
    exact = tokens.select("token").join(references.select("token", F.lit(True).alias("igual")), "token", "left")
    out = exact.join(best, "token", "left").join(halves, "token", "left")
    certo = F.coalesce("ref", "token") if own else F.when(F.col("igual"), F.col("token")).otherwise(F.col("ref"))
    whole = F.when(certo.isNotNull(), F.array(certo))
    return out.select("token", F.coalesce(F.when(F.col("ref").isNull(), F.col("partes")), whole).alias("certos"))


def corrected(forms: DataFrame, fixes: DataFrame) -> DataFrame:
    """forms with tokens replaced by their corrections, in order."""
    each = forms.select("texto", "sufixo", F.posexplode("tokens").alias("i", "token")).join(fixes, "token", "left")
    parts = each.select("texto", "sufixo", F.struct("i", F.coalesce("certos", F.array("token")).alias("c")).alias("p")).groupBy("texto", "sufixo").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return parts.select("texto", "sufixo", F.flatten(F.transform("p", lambda x: x["c"])).alias("tokens"))


BLOCK = ["t1", "t2", "sufixo"]


def blocks(forms: DataFrame, hot: int = 400) -> DataFrame:
    """(t1, t2, sufixo, t3, chave, tokens, sonda, grande): each form (chave, tokens, sufixo, sonda) in the block of each pair of its long tokens.

    In a block of more than ``hot`` forms, t3 goes through the first three letters of each further token. Tokens that
    may pair share one of them: initials, abbreviations and nicknames the first letter, typing errors of one or two
    letters one of the first three. Forms of nothing but short further tokens, which may be acronyms, meet in '' too.
    """
    long_ = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: F.length(t) >= 4)))
    each = forms.withColumn("k", long_).filter("size(k) >= 2")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("k") - 1), lambda i: F.transform(F.slice("k", i + 1, F.size("k")), lambda y: F.struct(F.element_at("k", i).alias("t1"), y.alias("t2")))))
    keyed = each.select("chave", "tokens", "sufixo", "sonda", F.explode(pairs).alias("p")).select("chave", "tokens", "sufixo", "sonda", "p.t1", "p.t2")
    big = keyed.groupBy(*BLOCK).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(*BLOCK, F.lit(True).alias("grande"))
    rest = F.filter("tokens", lambda t: (t != F.col("t1")) & (t != F.col("t2")))
    letters = F.array_distinct(F.flatten(F.transform(rest, lambda t: F.split(F.substring(t, 1, 3), ""))))
    short = F.when(F.forall(rest, lambda t: F.length(t) <= 4), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    third = F.when(F.col("grande"), F.array_distinct(F.concat(letters, short))).otherwise(F.array(F.lit("")))
    return keyed.join(big, BLOCK, "left").select(*BLOCK, F.explode(third).alias("t3"), "chave", "tokens", "sonda", F.coalesce("grande", F.lit(False)).alias("grande"))


def block_links(split: DataFrame) -> DataFrame:
    """(chave, outra, sonda): star links within the blocks."""
    block = [*BLOCK, "t3"]
    ordered = split.select(*block, "chave", "tokens", "sonda").repartition(*block).sortWithinPartitions(*block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, bool]] = []
        for (t1, t2, _, _), block in groupby(rows(batches), key=lambda r: r[:4]):
            block = list(block)
            if len(block) > 1:
                probes = {r[4] for r in block if r[6]}
                out += [(a, b, a in probes) for a, b in link_block(t1, t2, [(r[4], r[5], r[6]) for r in block])]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["chave", "outra", "sonda"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["chave", "outra", "sonda"])

    return ordered.mapInArrow(run, "chave string, outra string, sonda boolean")


def sole_links(split: DataFrame, parts: DataFrame) -> DataFrame:
    """(chave, outra, sonda): in split blocks, the forms of nothing but the two tokens, where all fuller forms are one entity of parts (chave, entidade)."""
    hot = split.filter("grande")
    bare = hot.filter("size(tokens) = 2").select(*BLOCK, "chave", "sonda").distinct()
    fuller = hot.filter("size(tokens) > 2 AND NOT sonda").select(*BLOCK, "chave").distinct().join(parts, "chave")
    sole = fuller.groupBy(*BLOCK).agg(F.min("entidade").alias("outra"), F.max("entidade").alias("ultima")).filter("outra = ultima")
    return bare.join(sole, BLOCK).select("chave", "outra", "sonda")


def short_links(forms: DataFrame) -> DataFrame:
    """(chave, outra, sonda): links of names without two long tokens: all tokens equal but one, which differs by one edit.

    The forms that share what is left after deleting a letter of one token are linked to the least of them.
    """
    short = forms.filter("NOT sonda AND size(filter(tokens, t -> length(t) >= 4)) < 2 AND size(tokens) >= 2")
    each = short.select("chave", "sufixo", "tokens", F.posexplode("tokens").alias("i", "token")).filter("length(token) >= 3")
    others = F.array_sort(F.filter("tokens", lambda t, n: n != F.col("i")))
    keyed = each.select("chave", "sufixo", "token", F.concat_ws(" ", others).alias("outros"), F.explode(deletions(F.col("token"))).alias("resto"))
    key = ["sufixo", "outros", "resto"]
    least = keyed.groupBy(*key).agg(F.min(F.struct("chave", "token")).alias("m")).select(*key, F.col("m.chave").alias("outra"), F.col("m.token").alias("t"))
    return keyed.join(least, key).filter("chave <> outra AND levenshtein(token, t, 1) >= 0").select("chave", "outra", F.lit(False).alias("sonda")).distinct()


def components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(chave, entidade): the least key of each node's connected component, by minimum labels and pointer jumping."""
    both = stage(links.select(F.col("chave").alias("a"), F.col("outra").alias("b")).unionByName(links.select(F.col("outra").alias("a"), F.col("chave").alias("b"))).distinct(), "p2-ligacoes")
    labels = stage(nodes.select("chave", F.col("chave").alias("entidade")), "p2-rotulos")
    for _ in range(max_rounds):
        offered = both.join(labels, both["b"] == labels["chave"]).groupBy(F.col("a").alias("chave")).agg(F.min("entidade").alias("melhor"))
        lower = labels.join(offered, "chave", "left").select("chave", "entidade", F.least("entidade", F.coalesce("melhor", "entidade")).alias("nova"))
        jump = labels.select(F.col("chave").alias("nova"), F.col("entidade").alias("salto"))
        new = stage(lower.join(jump, "nova", "left").select("chave", F.least("nova", F.coalesce("salto", "nova")).alias("entidade"), (F.least("nova", F.coalesce("salto", "nova")) != F.col("entidade")).alias("mudou")), "p2-rotulos")
        moved = new.filter("mudou").limit(1).count()
        unstage(labels)
        labels = new.select("chave", "entidade")
        labels._staged_path = new._staged_path
        if not moved:
            unstage(both)
            return labels
    raise RuntimeError(f"the components still change after {max_rounds} rounds")


def entities(autores: DataFrame, norma_autor: DataFrame, cargos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, entidade) of autores, (cargo_autor, entidade) of the titles that name an author).

    Null and letterless names form no entity; repeated rows count once; an id with several names belongs to the entity
    of each. A title that could mean two entities names none.
    """
    forms = stage(forms_of(autores, "nome").filter("size(tokens) > 0"), "p2-formas")
    counts = stage(forms.select("sufixo", F.array_join("tokens", " ").alias("x"), "tokens").dropDuplicates(["x", "sufixo"]).select(F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) >= 4").groupBy("token").agg(F.count("*").alias("n")), "p2-tokens")
    fixes = stage(corrections(counts, counts, own=True), "p2-correcoes")
    twice = fixes.select("token", F.explode("certos").alias("c")).join(fixes.select(F.col("token").alias("c"), F.col("certos").alias("d")), "c", "left").groupBy("token").agg(F.flatten(F.collect_list(F.coalesce("d", F.array("c")))).alias("certos"))
    ready = stage(corrected(forms, twice).withColumn("chave", F.concat_ws("|", F.array_join("tokens", " "), "sufixo")), "p2-formas")
    right = stage(ready.select("chave", "tokens").dropDuplicates(["chave"]).select(F.explode(F.array_distinct("tokens")).alias("token")).filter("length(token) >= 4").groupBy("token").agg(F.count("*").alias("n")), "p2-tokens")

    # names inside titles: tokens near an author's token that aren't words of titles
    titles = stage(forms_of(norma_autor, "cargo_autor"), "p2-titulos")
    words = titles.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    listed = forms_of(cargos, "cargo").select(F.explode("tokens").alias("token")).distinct()
    plain = words.filter("length(token) >= 4").join(listed, "token", "left_anti")
    title_like = neighbours(plain, listed).select("token").distinct().join(right, "token", "left_anti")
    probe_fixes = stage(corrections(stage(plain.join(title_like, "token", "left_anti"), "p2-palavras"), right, own=False).filter("certos IS NOT NULL"), "p2-correcoes")
    nick = words.filter("length(token) BETWEEN 3 AND 6").join(listed, "token", "left_anti").join(probe_fixes, "token", "left_anti")
    starts = right.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(6)), lambda i: F.when(F.length("token") > i + 1, F.substring("token", F.lit(1), i)))).alias("token")).filter("token IS NOT NULL").distinct()
    abbreviated = listed.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(6)), lambda i: F.substring("token", F.lit(1), i))).alias("token")).distinct()
    nick = nick.join(starts, "token", "left_semi").join(abbreviated, "token", "left_anti").select("token", F.array("token").alias("apelido"))
    each = titles.select("texto", "sufixo", F.posexplode("tokens").alias("i", "token")).join(probe_fixes, "token", "left").join(nick, "token", "left")
    kind = F.when(F.col("certos").isNotNull(), F.col("certos")).when(F.col("apelido").isNotNull(), F.col("apelido")).when((F.length("token") == 1), F.array("token")).when(F.expr("length(token) <= 8 AND length(token) % 2 = 0 AND left(token, length(token) div 2) = right(token, length(token) div 2)"), F.array("token"))
    line = each.groupBy("texto", "sufixo").agg(F.array_sort(F.collect_list(F.struct("i", kind.alias("c"), F.col("certos").isNotNull().alias("forte")))).alias("p"))
    # the span of the name: from two places before the first long token to one behind the last
    strong = F.transform(F.filter("p", lambda x: x["forte"]), lambda x: x["i"])
    named = line.withColumn("s", strong).filter("size(s) >= 1")
    span = F.filter("p", lambda x: x["c"].isNotNull() & (x["i"] >= F.array_min("s") - 2) & (x["i"] <= F.array_max("s") + 2))
    probes = stage(named.select("texto", "sufixo", F.flatten(F.transform(span, lambda x: x["c"])).alias("tokens")).withColumn("chave", F.concat_ws("|", F.lit("*"), F.array_join("tokens", " "), "sufixo")), "p2-sondas")

    nodes = ready.select("chave", "tokens", "sufixo").dropDuplicates(["chave"]).withColumn("sonda", F.lit(False))
    asked = probes.select("chave", "tokens", "sufixo").dropDuplicates(["chave"]).withColumn("sonda", F.lit(True))
    every = stage(nodes.unionByName(asked), "p2-nos")
    split = stage(blocks(every), "p2-blocos")
    links = stage(block_links(split).unionByName(short_links(every)), "p2-elos")
    parts = components(nodes, links.filter("not sonda"))
    more = stage(sole_links(split, parts), "p2-elos")
    if more.limit(1).count():
        links = links.unionByName(more)
        parts = components(nodes, links.filter("not sonda"))
    people = autores.select(F.col("id"), F.col("nome").alias("texto")).filter("id IS NOT NULL").distinct().join(ready.select("texto", "chave"), "texto").join(parts, "chave").select("id", "entidade").distinct()
    meant = links.filter("sonda").join(parts.select(F.col("chave").alias("outra"), "entidade"), "outra").groupBy("chave").agg(F.min("entidade").alias("entidade"), F.max("entidade").alias("ultima")).filter("entidade = ultima")
    named_in = probes.select(F.col("texto").alias("cargo_autor"), "chave").join(meant.select("chave", "entidade"), "chave").select("cargo_autor", "entidade")
    return stage(people, "p2-autores"), stage(named_in, "p2-nomeados")


def found(autores: DataFrame, norma_autor: DataFrame, cargos: DataFrame) -> DataFrame:
    """(id_norma, id_a, id_b): with id_norma 0 the pairs of ids of one entity; else a row's author and the lowest id of the other person its title names."""
    people, named = entities(autores, norma_autor, cargos)
    sizes = stage(people.groupBy("entidade").agg(F.count("*").alias("n"), F.min("id").alias("outro")), "p2-entidades")
    lowest = sizes.select("entidade", "outro")
    # the pairs of a big entity are made in shares of about a thousand ids
    several = people.join(sizes.filter("n > 1").select("entidade", F.expr("CAST(n DIV 1000 AS INT) + 1").alias("partes")), "entidade")
    other = several.select(F.col("id").alias("id_b"), "entidade", F.explode(F.sequence(F.lit(0), F.col("partes") - 1)).alias("parte"))
    pairs = several.select(F.col("id").alias("id_a"), "entidade", F.pmod(F.hash("id"), F.col("partes")).alias("parte")).join(other, ["entidade", "parte"]).filter("id_a < id_b").select(F.lit(0).cast("bigint").alias("id_norma"), "id_a", "id_b")
    target = small(stage(named.join(lowest, "entidade"), "p2-alvos"))
    rows = norma_autor.select("id_norma", "id_autor", "cargo_autor").filter("id_norma IS NOT NULL AND id_autor IS NOT NULL").join(target, "cargo_autor")
    own = people.select(F.col("id").alias("id_autor"), F.col("entidade").alias("propria"))
    elsewhere = rows.join(own.withColumnRenamed("propria", "entidade"), ["id_autor", "entidade"], "left_anti").filter("id_autor <> outro")
    return pairs.unionByName(elsewhere.select("id_norma", F.least("id_autor", "outro").alias("id_a"), F.greatest("id_autor", "outro").alias("id_b"))).distinct()


def spellings(autores: DataFrame, norma_autor: DataFrame, cargos: DataFrame) -> DataFrame:
    """(id, entidade, ligacoes): each author's entity, by its lowest id, and to how many other ids it is linked."""
    people, _ = entities(autores, norma_autor, cargos)
    size = people.groupBy("entidade").agg(F.min("id").alias("menor"), F.countDistinct("id").alias("n"))
    return people.join(size, "entidade").select("id", F.col("menor").alias("entidade"), (F.col("n") - 1).alias("ligacoes")).distinct()
