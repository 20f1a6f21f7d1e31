"""Auctions of k equal items whose bidders hear of them through a network.

Tables: bids(auction, bidder, bid), reports(auction, bidder, reported), seller(auction, bidder). Results have a row for
every bid: (auction, bidder, allocated, payment). Whoever has no bid can't take part, but is counted among a
bidder's reports. Ties go to the lesser bidder. Auctions run side by side; each by itself is sequential.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.ship import ship

from .primitives import reached

#: The highest price that snca tries (fixed value).
TOP_PRICE = 50


def vcg(bids: DataFrame, reports: DataFrame, seller: DataFrame, k: int, semantics: str = "reference", max_hops: int | None = 2) -> DataFrame:
    """The k highest bids among those reached win and pay the next highest.

    With no more than k reached nobody wins; semantics="canonical" sells to them at 0.
    """
    rows = bids.select("auction", "bidder", F.col("bid").cast("double").alias("bid"))
    inside = reached(seller, reports, max_hops).select("auction", "bidder", F.lit(True).alias("inside"))
    rows = rows.join(inside, ["auction", "bidder"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    # A plain pass: the k + 1 best of each auction are found before anything else is sorted.
    best = rows.filter("inside").withColumn("place", F.row_number().over(Window.partitionBy("auction").orderBy(F.desc("bid"), "bidder"))).filter(F.col("place") <= k + 1)
    price = best.filter(F.col("place") == k + 1).select("auction", F.col("bid").alias("price"))
    winners = best.filter(F.col("place") <= k).join(price, "auction", "inner" if semantics == "reference" else "left").select("auction", "bidder", F.coalesce("price", F.lit(0.0)).alias("price"))
    out = rows.join(winners.withColumn("won", F.lit(True)), ["auction", "bidder"], "left")
    return out.select("auction", "bidder", F.coalesce("won", F.lit(False)).alias("allocated"), F.coalesce("price", F.lit(0.0)).alias("payment"))


def _each(bids: DataFrame, reports: DataFrame, seller: DataFrame, run: Callable[[dict, dict, set], dict]) -> DataFrame:
    """run(bids, reports, seller) -> payments of the winners, for each auction by itself."""
    id_kind, kind = (bids.schema[c].dataType.simpleString() for c in ("auction", "bidder"))
    none = F.lit(None)
    ship(bids.sparkSession)
    rows = bids.select("auction", F.lit(0).alias("what"), "bidder", none.cast(kind).alias("other"), F.col("bid").cast("double").alias("bid"))
    rows = rows.unionByName(reports.select("auction", F.lit(1).alias("what"), "bidder", F.col("reported").cast(kind).alias("other"), none.cast("double").alias("bid")))
    rows = rows.unionByName(seller.select("auction", F.lit(2).alias("what"), "bidder", none.cast(kind).alias("other"), none.cast("double").alias("bid")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        given = pdf[pdf["what"] == 0]
        bid = dict(zip(given["bidder"].tolist(), given["bid"].tolist(), strict=True))
        said: dict = {}
        for b, o in pdf.loc[pdf["what"] == 1, ["bidder", "other"]].itertuples(index=False):
            said.setdefault(b, set()).add(type(b)(o))
        won = run(bid, said, set(pdf.loc[pdf["what"] == 2, "bidder"].tolist()) & set(bid)) if bid else {}
        names = sorted(bid)
        return pd.DataFrame({"auction": [pdf["auction"].iloc[0]] * len(names), "bidder": names, "allocated": [n in won for n in names], "payment": [float(won.get(n, 0)) for n in names]})

    return rows.groupBy("auction").applyInPandas(one, f"auction {id_kind}, bidder {kind}, allocated boolean, payment double")


def mudan(bids: DataFrame, reports: DataFrame, seller: DataFrame, k: int) -> DataFrame:
    """Diffusion auction: those who can't win any more, or have won, spread the news; the possible winner with most reports wins next, at the price of the best bid that it keeps out."""

    def run(bid: dict, said: dict, start: set) -> dict:
        known, items, told, paid = set(start), k, set(), {}
        rank = lambda names: sorted(names, key=lambda n: (-bid[n], n))

        def possible() -> set:
            rest = known - paid.keys()
            return rest if len(rest) <= items else set(rank(rest)[:items])

        front = possible()
        while front:
            teller = (known - front) - told
            told |= teller
            known |= {o for t in teller for o in said.get(t, ()) if o in bid}
            front = possible()
            rest = known - paid.keys()
            winner = min(front, key=lambda n: (-len(said.get(n, ())), n))
            others = rank(rest - {winner})
            paid[winner] = bid[others[items - 1]] if len(rest) > items and len(others) >= items else 0
            items -= 1
            front = possible()
        return paid

    return _each(bids, reports, seller, run)


def snca(bids: DataFrame, reports: DataFrame, seller: DataFrame, k: int, start_price: int | None = None, seed: int = 0) -> DataFrame:
    """Ascending-price auction: whoever the price leaves behind spreads the news; the price stays where demand and supply meet.

    start_price: of the first round; if not given, one from 0 to TOP_PRICE by the seed.
    """
    import random

    first = start_price if start_price is not None else random.Random(seed).randint(0, TOP_PRICE)

    def run(bid: dict, said: dict, start: set) -> dict:
        near, price, items = set(start), first, k
        waiting, gone, paid = set(bid), set(), {}
        reach = lambda n: {o for o in said.get(n, ()) if o in bid}
        buyers = lambda p: [n for n in near if bid[n] >= p and n not in paid]
        # An agent is decisive when demand equals supply exactly and it is part of the demand.
        decisive = lambda p: buyers(p) if items > 0 and len(buyers(p)) == items else []
        by_reports = lambda n: (-bid[n], -len(said.get(n, ())), n)
        by_open_reports = lambda n: (-bid[n], -len(said.get(n, ())) if n in said and n not in gone else 0, n)

        def sell(queue: list, p: float) -> None:
            if queue:
                winner = queue[0]
                paid[winner] = p
                if winner not in gone:
                    near.update(reach(winner))
                near.discard(winner)
                gone.add(winner)

        while items > 0 and waiting:
            out = {n for n in waiting if bid[n] < price}
            gone |= out
            waiting -= out
            near -= out
            for n in out:
                near |= reach(n)
            able = lambda p: sorted((n for n in near if bid[n] >= p), key=by_open_reports)
            if decisive(price):
                sell(sorted(decisive(price), key=by_reports), price)
            elif len(buyers(price)) < items:
                sell(able(price), price)
            else:
                steps = range(price + 1, max(price + 1, TOP_PRICE + 1) + 1) if price <= TOP_PRICE else range(0)
                meet = next((p for p in steps if not decisive(p) and decisive(p + 1)), None)
                if meet is not None:
                    price = meet
                    sell(sorted(decisive(price + 1), key=by_reports), price)
                else:
                    price = next((p for p in steps if len(buyers(p)) <= items), max([price, *steps])) - 1
                    sell(able(price), price)
            items -= 1
        return paid

    return _each(bids, reports, seller, run)
