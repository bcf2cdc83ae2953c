"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells, one per combination of the margins (source, language, topic). A cell's tokens
are scaled, margin after margin, until each margin's categories hold their target shares (raking). The
factors of a cell over the largest factor of all are the probabilities its documents are drawn with: the
sample's expected shares are the targets, no document is drawn twice, and no larger sample is possible
without that. The rarer a category, the larger its factor, and the smaller the sample: `least` lets null
and very small categories keep their own share, so that they do not scale all others down. Only the table of cells, whose rows are combinations of categories, is iterated over.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from sparkboard.llm.shared import WORD, column, dropped, free_name, saved

#: What a null category counts as.
MISSING = "(none)"


def topic(text: Column) -> Column:
    """A document's kind by its signs: table, symbols, shouted, prose or empty."""
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    signs = F.regexp_count(text, F.lit("[#*$%&<>]"))
    shouts = n - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return (
        F.when(text.isNull() | (n == 0), "empty")
        .when(bars * 50 > n, "table")
        .when(signs * 20 > n, "symbols")
        .when(shouts * 20 > n, "shouted")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Targets in proportion to the margin's token shares to a power: 1 keeps them, 0 makes all alike."""
    return cells.where("tokens > 0").groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))


def lenient(cells: DataFrame, margin: str, power: float, least: float) -> DataFrame:
    """The targets of `tempered`, but null and very small categories keep the share of the tokens they have.

    Very small are categories with less than the share `least` of the largest one's tokens, nulls not looked
    at. Within a margin the factors of the others then differ by at most least ** (power - 1) (powers up to 1).
    """
    sums = cells.where("tokens > 0").groupBy(margin).agg(F.sum("tokens").cast("double").alias("n"))
    named = F.col(margin) != MISSING
    largest = sums.agg(F.max(F.when(named, F.col("n"))).alias("largest"))
    sums = sums.crossJoin(largest).withColumn("drawn", F.coalesce(named & (F.col("n") >= F.col("largest") * least), F.lit(False)))
    tempered_n = F.pow("n", F.lit(power))
    scale = sums.agg((F.sum(F.when(F.col("drawn"), tempered_n)) / F.sum(F.when(F.col("drawn"), F.col("n")))).alias("scale"))
    own = F.col("n") * F.coalesce("scale", F.lit(1.0))
    return sums.crossJoin(scale).select(margin, F.when(F.col("drawn"), tempered_n).otherwise(own).alias("target"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = 12, tolerance: float = 1e-12) -> DataFrame:
    """The cells with `weight`, the factor that gives every margin its target shares, and `departure`.

    `cells` has a column per margin and `tokens`. Targets (category, target) need not sum to one; a
    category without a target has weight 0, targets of categories without tokens change nothing, nor do
    cells without tokens. A round scales to each margin in turn, by an aggregation to categories joined back, and is
    written, so that neither the plan nor a task grows with the rounds. Rounds end when no category's share
    departs by more than `tolerance` of it from its target, or after `rounds` of them; `departure`, the same in
    every row, bounds what is left then: it stays large if the targets contradict each other.
    """
    now = cells.withColumn("weight", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0))
    for margin, target in targets.items():
        wanted = target.where("target > 0").groupBy(margin).agg(F.sum("target").alias(f"_{margin}"))
        now = now.join(wanted, margin, "left").withColumn("weight", F.when(F.col(f"_{margin}").isNull(), 0.0).otherwise(F.col("weight")))
    now, left = saved(now, "mix"), 0.0
    for _ in range(rounds):
        after = now
        for margin in targets:
            has = after.where("weight > 0").groupBy(margin).agg(F.sum(F.col("weight") * F.col("tokens")).alias("_has"))
            scaled = F.coalesce(F.col("weight") * F.col(f"_{margin}") / F.col("_has"), F.lit(0.0))
            after = after.join(has, margin, "left").withColumn("weight", scaled).drop("_has")
        after = saved(after, "mix")
        dropped(now)
        now, left = after, departure(after, list(targets))
        if left <= tolerance:
            break
    return now.select(*cells.columns, "weight", F.lit(left).alias(free_name("departure", cells.columns)))


def departure(cells: DataFrame, margins: list[str]) -> float:
    """Within any margin, the largest over the smallest ratio of what a category has to its target (column `_margin`), less one."""
    of = [F.struct(F.lit(m).alias("margin"), F.col(m).cast("string").alias("category"), F.col(f"_{m}").alias("target")) for m in margins]
    if not of:
        return 0.0
    rows = cells.where("weight > 0").select(F.explode(F.array(*of)).alias("of"), (F.col("weight") * F.col("tokens")).alias("n"))
    shares = rows.groupBy("of.margin", "of.category").agg((F.sum("n") / F.max("of.target")).alias("ratio"))
    spread = shares.groupBy("margin").agg((F.max("ratio") / F.min("ratio") - 1).alias("spread"))
    return spread.agg(F.max("spread")).first()[0] or 0.0


def chance(id_col: Column, text_col: Column, seed: int) -> Column:
    """A number in [0, 1) which depends on the document alone: on its id, without one on its text."""
    key = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(
    docs: DataFrame, margins: Mapping[str, Column], powers: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text",
    targets: Mapping[str, DataFrame] | None = None, rounds: int = 12, seed: int = 1,
    least: float | None = None, name: str = "mix",
) -> DataFrame:
    """The documents, all columns as they were, with a column `name`: (margins, n_tokens, probability, kept, departure),
    the last one as `raked` gives it.

    `margins` names the category columns; targets are the token shares raised to `powers`, or the tables of
    `targets`. With `least`, null and very small categories keep their own share (see `lenient`); without it
    one rare category may leave hardly any row. A null category is the category "(none)". A text without a word has no tokens: it adds
    nothing to a mix and has probability 0. Repeated rows of one id share its luck. A column of the documents called like the new one is
    left out for it.
    """
    text = column(text_col).cast("string")
    tokens = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    own, cell, odd, off = (free_name(f"__mix_{x}", docs.columns) for x in ("own", "cell", "odds", "off"))
    categories = [F.coalesce(c.cast("string"), F.lit(MISSING)).alias(m) for m, c in margins.items()]
    facts = docs.withColumn(own, F.struct(*categories, tokens.alias("n_tokens")))
    by = [F.col(f"{own}.{m}").alias(m) for m in margins]
    cells = saved(facts.groupBy(*by).agg(F.sum(f"{own}.n_tokens").alias("tokens")), "mix-cells")
    targets = targets or {m: tempered(cells, m, p) if least is None else lenient(cells, m, p, least) for m, p in powers.items()}
    weights = raked(cells, targets, rounds)
    top = weights.agg(F.max("weight")).first()[0] or 1.0
    left = free_name("departure", cells.columns)
    odds = weights.select(F.struct(*margins).alias(cell), (F.col("weight") / top).alias(odd), F.col(left).alias(off))
    p = F.when(F.col(f"{own}.n_tokens") > 0, F.col(odd)).otherwise(0.0)
    mix = F.struct(f"{own}.*", p.alias("probability"), (chance(column(id_col), text, seed) < p).alias("kept"), F.col(off).alias(left)).alias(name)
    on = [F.col(f"{own}.{m}") == F.col(f"{cell}.{m}") for m in margins]
    return facts.join(odds, on, "left").select(*[column(c) for c in docs.columns if c.lower() != name.lower()], mix)


def mixed_sql(margins: Mapping[str, str], powers: Mapping[str, float], rounds: int = 12, seed: int = 1, table: str = "documents", least: float | None = None) -> str:
    """The same for DuckDB, from margins without targets of their own: (doc_id, margins, n_tokens, probability, kept)."""
    names = list(margins)
    steps = [
        f"""facts AS MATERIALIZED (SELECT doc_id, text, {", ".join(f"coalesce({e}, '{MISSING}') AS {m}" for m, e in margins.items())},
            coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens FROM {table})""",
        f"cells AS MATERIALIZED (SELECT {', '.join(names)}, sum(n_tokens)::BIGINT AS tokens FROM facts GROUP BY ALL)",
    ]
    for m in names:
        p = powers[m]
        if least is None:
            steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens)::DOUBLE, {p}) AS target FROM cells WHERE tokens > 0 GROUP BY {m})")
            continue
        steps.append(f"n_{m} AS (SELECT {m}, sum(tokens)::DOUBLE AS n FROM cells WHERE tokens > 0 GROUP BY {m})")
        steps.append(
            f"""d_{m} AS (SELECT *, coalesce({m} <> '{MISSING}' AND n >= {least} * (SELECT max(n) FROM n_{m} WHERE {m} <> '{MISSING}'), false) AS drawn FROM n_{m})"""
        )
        scale = f"coalesce((SELECT sum(pow(n, {p})) / sum(n) FROM d_{m} WHERE drawn), 1.0)"
        steps.append(f"t_{m} AS MATERIALIZED (SELECT {m}, CASE WHEN drawn THEN pow(n, {p}) ELSE n * {scale} END AS target FROM d_{m})")
    steps.append("w0 AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM cells)")
    k = 0
    for _ in range(rounds):
        for m in names:
            k += 1
            steps.append(
                f"""w{k} AS MATERIALIZED (SELECT c.* EXCLUDE (weight), coalesce(c.weight * t.target / h.has, 0) AS weight FROM w{k - 1} c
                LEFT JOIN t_{m} t USING ({m}) LEFT JOIN (SELECT {m}, sum(weight * tokens) AS has FROM w{k - 1} WHERE weight > 0 GROUP BY {m}) h USING ({m}))"""
            )
    return f"""WITH {", ".join(steps)}, p AS (
        SELECT f.*, CASE WHEN n_tokens > 0 THEN w.weight / (SELECT max(weight) FROM w{k}) ELSE 0.0 END AS probability,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)} AS luck
        FROM facts f JOIN w{k} w USING ({", ".join(names)}))
        SELECT doc_id, {", ".join(names)}, n_tokens::BIGINT AS n_tokens, round(probability, 8) AS probability, luck < probability AS kept FROM p"""


#: SQL for `topic`.
TOPIC_SQL = """CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty'
    WHEN (length(text) - length(replace(text, '|', ''))) * 50 > length(text) THEN 'table'
    WHEN (length(text) - length(regexp_replace(text, '[#*$%&<>]', '', 'g'))) * 20 > length(text) THEN 'symbols'
    WHEN (length(text) - length(replace(text, '!', ''))) * 20 > length(text) THEN 'shouted' ELSE 'prose' END"""
