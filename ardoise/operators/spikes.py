"""Implausible readings per source: a hidden Markov model with four states.

Every series (one field, one source, one lot, in order of id) passes through the states *normal*,
*spike*, *stuck* and *out of range*.  Emissions:

- normal: the reading's distance from the usual level of its source and peer group, in robust
  standard deviations, under a standard normal density;
- spike: a flat density over ``SPIKE_WIDTH`` deviations, times what the producer's mark says;
- stuck: how much likelier it is that another award within ``REACH`` rows of the series has exactly
  the same value if the series is frozen than by chance, chance being how often the rest of the
  source gives that value; other rows may lie between;
- out of range: certain where a hard bound is broken, impossible elsewhere.

How often a source enters each state, and what its producer's marks are worth, is estimated for each
source from its own rows, shrunk towards ``RATES`` and ``HINT`` where a source has few.

Forward-backward probabilities then give each row its state.  A series may be arbitrarily long, so
the rows are cut by ranges of id into blocks of about ``BLOCK`` rows: each block first reduces to one
4 x 4 transfer matrix per series, the matrices of a series are composed in a tree of fan-in ``FAN``
to get the message entering each block from both sides, and each block then finishes alone.  A task
never holds more than one block, or ``FAN`` matrices of a series, however many rows one source has.

Levels and scales come from one table of counts by rounded level, never from a collected group.

Defined results: null readings are never flagged and take no part in a series; a null source or
group is a group of its own; repeated rows are judged one by one; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.session import materialise, small

BLOCK = 1 << 15
FAN = 1 << 12
STATES = ("normal", "pic", "fige", "hors_bornes")
# How often a source enters spike, stuck and out of range to begin with, and how many rows that counts for.
RATES, RATES_ROWS = (0.003, 0.0005, 0.001), 20_000.0
# How often a frozen stretch ends at the next row.
THAW = 0.04
SPIKE_WIDTH = 80.0
# The producer's own mark multiplies the odds of a spike by this much to begin with; so many marked rows weigh as much.
HINT, HINT_ROWS = 6.0, 50.0
# Rows count as far or near when the worth of the marks is estimated.
FAR, NEAR = 6.0, 3.0
# Rows a group needs before its own level outweighs the additive level of source and peer group.
SHRINK = 30.0
# Rows of a series within which a held value comes again; share of a frozen stretch that carries it; how often, at
# least, other causes (corrections, shared contracts) put one value twice within reach.
REACH, HELD_SHARE, OTHER_CAUSES = 16, 0.7, 0.035
STUCK_LEAST = 3
# Levels are counted on a grid of this step.
GRID = 0.002


def counted_levels(df: DataFrame) -> DataFrame:
    """(champ, source, groupe, niveau, n): rows by level rounded to ``GRID``, combined on the map side."""
    level = (F.round(F.col("niveau") / GRID) * GRID).alias("niveau")
    return df.filter(F.col("niveau").isNotNull()).groupBy("champ", "source", "groupe", level).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(counts: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return counts.groupBy(*keys).agg(q.alias("_q"), F.sum("n").alias(f"{prefix}_n")).select(*keys, F.col("_q")[1].alias(f"{prefix}_m"), ((F.col("_q")[2] - F.col("_q")[0]) / 1.349).alias(f"{prefix}_e"), f"{prefix}_n")


def _join(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that also matches null keys."""
    right = stats.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def standardised(df: DataFrame) -> DataFrame:
    """Adds ``z``: distance of ``niveau`` from what its source and group normally give, in robust deviations.

    Needs champ, source, groupe, niveau.  The level is that of the (source, group) cell, shrunk
    towards source level + group level where the cell has few rows; the scale is that of the group
    over all sources, likewise shrunk towards the scale of the source.
    """
    counts = materialise(counted_levels(df), "niveaux")
    by_source = small(_quartiles(counts, ["champ", "source"], "niveau", "s"), "sources")
    rest = _join(counts, by_source, ["champ", "source"]).withColumn("_r", F.col("niveau") - F.col("s_m"))
    by_group = small(_quartiles(rest, ["champ", "groupe"], "_r", "g"), "groupes")
    by_cell = small(_quartiles(rest, ["champ", "source", "groupe"], "_r", "c"), "cellules")
    one = _join(df, by_source, ["champ", "source"]).withColumn("_r", F.col("niveau") - F.col("s_m"))
    two = _join(_join(one, by_group, ["champ", "groupe"]), by_cell, ["champ", "source", "groupe"])
    additive = F.coalesce(F.col("g_m"), F.lit(0.0))
    level = (F.coalesce(F.col("c_n"), F.lit(0)) * F.coalesce(F.col("c_m"), F.lit(0.0)) + SHRINK * additive) / (F.coalesce(F.col("c_n"), F.lit(0)) + SHRINK)
    scale = (F.coalesce(F.col("g_n"), F.lit(0)) * F.coalesce(F.col("g_e"), F.lit(0.0)) + SHRINK * F.col("s_e")) / (F.coalesce(F.col("g_n"), F.lit(0)) + SHRINK)
    return two.withColumn("z", F.when(scale > 0, (F.col("_r") - level) / scale)).drop("s_m", "s_e", "s_n", "g_m", "g_e", "g_n", "c_m", "c_e", "c_n", "_r")


def repeated_values(df: DataFrame, round_value: Column) -> DataFrame:
    """(champ, source, lot, valeur, premier, dernier, taux): values that at least STUCK_LEAST awards of a series carry.

    taux: how often an award of the rest of the source carries the value; premier, dernier: the first and
    last id of the series with it.  These alone can be held; whether they are is the model's to say.
    """
    per_award = df.groupBy("champ", "source", "lot", "valeur", "attribution").agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    per_series = materialise(per_award.groupBy("champ", "source", "lot", "valeur").agg(F.count(F.lit(1)).alias("repete"), F.min("_a").alias("premier"), F.max("_b").alias("dernier")), "par-serie")
    sizes = small(per_series.groupBy("champ", "source", "lot").agg(F.sum("repete").alias("serie_n")), "series")
    source_sizes = sizes.groupBy("champ", "source").agg(F.sum("serie_n").alias("source_n"))
    often = per_series.filter(F.col("repete") >= STUCK_LEAST)
    values = small(often.select("champ", "valeur").distinct(), "valeurs")
    per_value = per_series.join(values, ["champ", "valeur"], "left_semi").groupBy("champ", "source", "valeur").agg(F.sum("repete").alias("partout"))
    x = _join(_join(_join(often, sizes, ["champ", "source", "lot"]), source_sizes, ["champ", "source"]), per_value, ["champ", "source", "valeur"])
    elsewhere = F.col("partout") - F.col("repete") + F.when(round_value, 2.0).otherwise(0.5)
    rate = F.least(F.lit(1.0), elsewhere / F.greatest(F.col("source_n") - F.col("serie_n"), F.col("serie_n")))
    return x.select("champ", "source", "lot", "valeur", "premier", "dernier", rate.alias("taux"))


def source_rates(df: DataFrame) -> DataFrame:
    """(champ, source, p_pic, p_fige, p_hors, indice_vaut): each source's own parameters, from counts of its rows."""
    far, near = F.abs("z") > FAR, F.abs("z") < NEAR
    n = df.groupBy("champ", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(far & ~F.col("hors")).alias("loin"), F.count_if("hors").alias("hors_n"), F.count_if(F.col("taux").isNotNull()).alias("tenus"),
        F.count_if(far & F.col("indice")).alias("loin_i"), F.count_if(near & F.col("indice")).alias("pres_i"), F.count_if(near).alias("pres"),
    )
    shrunk = lambda k, rate: (F.col(k) + RATES_ROWS * rate) / (F.col("n") + RATES_ROWS)
    usual = (F.col("pres_i") + 1.0) / (F.col("pres") + 100.0)
    worth = (F.col("loin_i") + HINT_ROWS * HINT * usual) / ((F.col("loin") + HINT_ROWS) * usual)
    # A value carried by several awards of a series is as a rule not held: one entry for each hundred such rows.
    return n.select("champ", "source", shrunk("loin", RATES[0]).alias("p_pic"), ((F.col("tenus") / 100.0 + RATES_ROWS * RATES[1]) / (F.col("n") + RATES_ROWS)).alias("p_fige"), shrunk("hors_n", RATES[2]).alias("p_hors"), F.least(F.greatest(worth, F.lit(1.0)), F.lit(60.0)).alias("indice_vaut"))


def _transitions(spike: float, stuck: float, out: float) -> np.ndarray:
    """Rows: state before, columns: state after."""
    enter = np.array([1 - spike - stuck - out, spike, stuck, out])
    stay = np.array([THAW, spike, 1 - THAW - spike - out, out])
    return np.stack([enter, enter, stay, enter])


def _within_reach(x: pd.DataFrame) -> np.ndarray:
    """Rows of one series of a block whose value another award carries within REACH rows, in the block or beyond its ends."""
    n, out = len(x), np.zeros(len(x), bool)
    at = np.nonzero(x["taux"].notna().to_numpy())[0]
    if not len(at):
        return out
    value, award = x["valeur"].to_numpy(float)[at], x["attribution"].to_numpy()[at]
    order = np.lexsort((at, value))
    p, v, a = at[order], value[order], award[order]
    for k in range(1, min(REACH, len(p) - 1) + 1):
        near = (v[k:] == v[:-k]) & (p[k:] - p[:-k] <= REACH) & (a[k:] != a[:-k])
        out[p[k:][near]] = out[p[:-k][near]] = True
    ids = x["id"].to_numpy()
    before, after = x["premier"].to_numpy(float)[at] < ids[0], x["dernier"].to_numpy(float)[at] > ids[-1]
    # Next to an end of the block, the value's rows beyond that end count.
    lone = ~out[at] & (((at < REACH) & before) | ((at >= n - REACH) & after))
    out[at[lone]] = True
    return out


def _emissions(z: np.ndarray, held: np.ndarray, rate: np.ndarray, out: np.ndarray, hint: np.ndarray, worth: float) -> np.ndarray:
    normal = np.exp(-0.5 * np.minimum(np.abs(z), 37.0) ** 2) / np.sqrt(2 * np.pi)
    spike = np.where(hint, worth, 1.0) / SPIKE_WIDTH
    either = normal + 0.003 * spike
    e = np.empty((len(z), 4))
    e[:, 0], e[:, 1] = normal, spike
    # Chance that a value comes again within reach though nothing is frozen.
    chance = np.minimum(1.0, 2 * REACH * np.nan_to_num(rate, nan=0.0) + OTHER_CAUSES)
    e[:, 2] = np.where(held, HELD_SHARE * either / chance, (1 - HELD_SHARE) * either)
    e[:, 3] = 0.0
    e[out] = (0.0, 0.0, 0.0, 1.0)
    return np.maximum(e, 1e-300)


def _prefix(m: np.ndarray) -> np.ndarray:
    """Running products of 4 x 4 matrices, each scaled to a largest entry of 1, by parallel prefix."""
    p, step = m.copy(), 1
    p /= p.max(axis=(1, 2), keepdims=True)
    while step < len(p):
        p[step:] = p[:-step] @ p[step:]
        p /= p.max(axis=(1, 2), keepdims=True)
        step *= 2
    return p


def _series(pdf: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each series of a block: its key, rows, transfer matrices, emissions, and which rows are within reach of their value."""
    pdf = pdf.sort_values("id", kind="stable")
    for key, x in pdf.groupby(["champ", "source", "lot"], dropna=False, sort=False):
        held, own = _within_reach(x), x.iloc[0]
        e = _emissions(x["z"].fillna(0.0).to_numpy(float), held, x["taux"].to_numpy(float), x["hors"].to_numpy(bool), x["indice"].to_numpy(bool), float(own["indice_vaut"]))
        t = _transitions(float(own["p_pic"]), float(own["p_fige"]), float(own["p_hors"]))
        yield key, x, t[None] * e[:, None, :], e, held


def _none(v: object) -> object:
    """A group key without pandas' not-a-number for null, whole numbers as int."""
    return None if v is None or v != v else v if isinstance(v, str) else int(v)


KEY = "champ string, source string, lot long"


def _block_matrices(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for (champ, source, lot), x, m, _, _ in _series(pdf):
        own = x.iloc[0]
        start = _transitions(float(own["p_pic"]), float(own["p_fige"]), float(own["p_hors"]))[0]
        rows.append((champ, _none(source), _none(lot), int(own["bloc"]), _prefix(m)[-1].ravel().tolist(), start.tolist()))
    return pd.DataFrame(rows, columns=["champ", "source", "lot", "bloc", "matrice", "debut"])


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """One matrix for each run of up to FAN blocks of a series."""
    rows = []
    for (champ, source, lot, over), x in pdf.sort_values("bloc", kind="stable").groupby(["champ", "source", "lot", "_sur"], dropna=False, sort=False):
        m = np.stack([np.asarray(v, float).reshape(4, 4) for v in x["matrice"]])
        rows.append((champ, _none(source), _none(lot), int(over), _prefix(m)[-1].ravel().tolist(), list(x["debut"].iloc[0])))
    return pd.DataFrame(rows, columns=["champ", "source", "lot", "bloc", "matrice", "debut"])


def _enter(pdf: pd.DataFrame, messages: pd.DataFrame | None) -> pd.DataFrame:
    """The messages that enter each block, from those that enter the run of blocks it belongs to."""
    known = None if messages is None else {(r.champ, _none(r.source), _none(r.lot), int(r.bloc)): (np.asarray(r.avant, float), np.asarray(r.apres, float)) for r in messages.itertuples()}
    rows = []
    for (champ, source, lot, over), x in pdf.sort_values("bloc", kind="stable").groupby(["champ", "source", "lot", "_sur"], dropna=False, sort=False):
        ms = [np.asarray(v, float).reshape(4, 4) for v in x["matrice"]]
        if known is None:
            ahead, behind = np.asarray(x["debut"].iloc[0], float), np.ones(4)
        else:
            ahead, behind = known[champ, _none(source), _none(lot), int(over)]
        before, after = [], []
        for m in ms:
            before.append(ahead)
            ahead = ahead @ m
            ahead = ahead / ahead.sum()
        for m in reversed(ms):
            after.append(behind)
            behind = m @ behind
            behind = behind / behind.sum()
        for b, p, q in zip(x["bloc"], before, reversed(after), strict=True):
            rows.append((champ, _none(source), _none(lot), int(b), p.tolist(), q.tolist()))
    return pd.DataFrame(rows, columns=["champ", "source", "lot", "bloc", "avant", "apres"])


MATRICES, MESSAGES = f"{KEY}, bloc long, matrice array<double>, debut array<double>", f"{KEY}, bloc long, avant array<double>, apres array<double>"


def entering_messages(matrices: DataFrame, blocks: int) -> DataFrame:
    """(champ, source, lot, bloc, avant, apres): what enters each block from both sides, over a tree of fan-in FAN.

    matrices: written, blocks numbered from 0 to ``blocks`` - 1.
    """
    x = matrices.withColumn("_sur", F.floor(F.col("bloc") / FAN))
    # Runs of blocks travel in buckets whose number follows that of the matrices.
    bucket = F.pmod(F.xxhash64("champ", "source", "lot", "_sur"), F.lit(max(16, -(-matrices.count() // 20_000)))).alias("_seau")
    if blocks <= FAN:
        return x.groupBy(bucket).applyInPandas(lambda pdf: _enter(pdf, None), MESSAGES)
    above = materialise(x.groupBy(bucket).applyInPandas(_products, MATRICES), "matrices")
    over = entering_messages(above, -(-blocks // FAN)).withColumn("_sur", F.col("bloc"))
    return x.groupBy(bucket).cogroup(over.groupBy(bucket)).applyInPandas(_enter, MESSAGES)


def _posterior(pdf: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
    known = {(r.champ, _none(r.source), _none(r.lot)): (np.asarray(r.avant, float), np.asarray(r.apres, float)) for r in messages.itertuples()}
    out = []
    for (champ, source, lot), x, m, e, held in _series(pdf):
        ahead, behind = known[champ, _none(source), _none(lot)]
        alpha = np.einsum("i,tij->tj", ahead, _prefix(m))
        # Backward messages: products from the right, by the same scan over transposed matrices.
        right = _prefix(m[::-1].transpose(0, 2, 1))
        beta = np.empty((len(x), 4))
        beta[-1] = behind
        if len(x) > 1:
            beta[:-1] = np.einsum("i,tij->tj", behind, right[:-1])[::-1]
        g = alpha * beta
        g /= g.sum(axis=1, keepdims=True)
        state = g.argmax(axis=1)
        # A row between held ones lies in the stuck stretch without being stuck itself.
        spike = float(x["p_pic"].iloc[0])
        state = np.where((state == 2) & ~held, np.where(e[:, 1] * spike > e[:, 0] * (1 - spike), 1, 0), state)
        out.append(pd.DataFrame({"champ": champ, "id": x["id"].to_numpy(), "etat": state.astype("int32"), "proba": g[np.arange(len(g)), g.argmax(axis=1)]}))
    return pd.concat(out) if out else pd.DataFrame({"champ": [], "id": [], "etat": [], "proba": []})


def flag_readings(readings: DataFrame, round_value: Column) -> DataFrame:
    """(champ, id, etat, proba) of every reading that is not in the normal state.

    readings: champ string, id long (unique within champ), source string, groupe string (peer
    group), lot long, valeur double, niveau double (the reading on its natural scale, null outside
    the bounds), attribution long (rows of one award count once), hors boolean (a hard bound is
    broken), indice boolean (the producer's own mark).
    """
    # Written once: what is read off contract numbers costs more than all the scans that follow.
    readings = materialise(readings, "releves")
    held = small(repeated_values(readings.filter(~F.col("hors")), round_value), "valeurs-repetees")
    x = _join(standardised(readings), held, ["champ", "source", "lot", "valeur"])
    x = x.select("champ", "id", "source", "lot", F.col("z").cast("float").alias("z"), "hors", "indice", F.when(F.col("taux").isNotNull(), F.col("valeur")).alias("valeur"), F.when(F.col("taux").isNotNull(), F.col("attribution")).otherwise(0).alias("attribution"), "premier", "dernier", "taux")
    blocks = max(1, -(-readings.count() // BLOCK))
    # Ranges of id with about equally many rows, however the ids lie.
    x = materialise(x.repartitionByRange(blocks, "id").withColumn("bloc", F.spark_partition_id().cast("long")), "lectures")
    x = _join(x, small(source_rates(x), "parametres"), ["champ", "source"])
    matrices = materialise(x.groupBy("bloc").applyInPandas(_block_matrices, MATRICES), "matrices")
    chains = entering_messages(matrices, blocks)
    found = x.groupBy("bloc").cogroup(chains.groupBy("bloc")).applyInPandas(_posterior, "champ string, id long, etat int, proba double")
    return found.filter(F.col("etat") > 0).withColumn("etat", F.array(*[F.lit(s) for s in STATES])[F.col("etat")])
