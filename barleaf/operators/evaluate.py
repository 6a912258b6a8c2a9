"""Weight evaluation: lagged weighted returns, costs, equity and metrics.

Weights stay long.  Only non-zero weights travel: the execution lag shifts the
date number, and turnover is the absolute net of each weight entering on its
date and leaving on the next, so no dates x tickers grid is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.windows import back, by_ticker

TRADING_DAYS = 252


@dataclass(frozen=True)
class Costs:
    commission_bps: float = 1.0
    slippage_bps: float = 2.0
    spread_bps: float = 1.0

    @property
    def rate(self) -> float:
        return (self.commission_bps + self.slippage_bps + self.spread_bps / 2.0) / 10_000.0


def returns_of(prices: DataFrame, price: str = "adj_close") -> DataFrame:
    change = F.col(price) / back(price) - 1
    return prices.select("date", "ticker", change.alias("ret")).filter("ret is not null")


def common_dates(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Dates both sides know, numbered from 0; one row per date."""
    both = returns.select("date").intersect(weights.select("date"))
    return both.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def cap_weights(weights: DataFrame, position_cap: float = 0.20, gross_cap: float = 1.0, by: tuple[str, ...] = ("date",)) -> DataFrame:
    """Clip each weight, then scale dates whose gross exposure exceeds the cap.

    A date holds one weight per name, so the gross is a window over the date.
    """
    clipped = weights.withColumn("weight", F.least(F.greatest(F.col("weight"), F.lit(-position_cap)), F.lit(position_cap)))
    clipped = clipped.withColumn("_gross", F.sum(F.abs("weight")).over(Window.partitionBy(*by)))
    scale = F.when(F.col("_gross") > gross_cap, gross_cap / F.greatest("_gross", F.lit(1e-12))).otherwise(1.0)
    return clipped.withColumn("weight", F.col("weight") * scale).drop("_gross")


def used_weights(prices: DataFrame, weights: DataFrame, delay: int = 1, gross_cap: float = 1.0, position_cap: float = 0.20):
    """(returns, dates, executed weights by date number); shared by the metrics."""
    returns = returns_of(prices)
    dates = common_dates(returns, weights)
    names = returns.select("ticker").distinct()
    w = weights.filter("weight <> 0").join(names, "ticker", "left_semi").join(dates, "date")
    w = cap_weights(w.select("i", "ticker", "weight"), position_cap, gross_cap, by=("i",))
    return returns, dates, w.select((F.col("i") + delay).alias("i"), "ticker", "weight")


def daily_results(prices: DataFrame, weights: DataFrame, costs: Costs = Costs(), delay: int = 1, gross_cap: float = 1.0, position_cap: float = 0.20, cash: float = 100_000.0) -> DataFrame:
    returns, dates, used = used_weights(prices, weights, delay, gross_cap, position_cap)
    # each weight enters on its date and leaves on the next: one pass gives the
    # position held and the change, which nets to the turnover
    steps = used.select(
        "ticker",
        F.explode(
            F.array(
                F.struct(F.col("i"), F.col("weight").alias("held"), F.col("weight").alias("moved")),
                F.struct((F.col("i") + 1).alias("i"), F.lit(0.0).alias("held"), (-F.col("weight")).alias("moved")),
            )
        ).alias("s"),
    ).select("ticker", "s.*")
    net = steps.groupBy("i", "ticker").agg(F.sum("held").alias("held"), F.sum("moved").alias("moved"))
    paid = net.join(dates, "i").join(returns, ["date", "ticker"], "left")
    totals = paid.groupBy("i").agg(
        F.sum(F.col("held") * F.coalesce("ret", F.lit(0.0))).alias("gross_ret"), F.sum(F.abs("moved")).alias("turnover")
    )
    daily = dates.join(totals, "i", "left").fillna(0.0, ["gross_ret", "turnover"])
    daily = daily.withColumn("cost", F.col("turnover") * costs.rate)
    daily = daily.withColumn("net_ret", F.col("gross_ret") - F.col("cost"))
    return with_equity(daily, cash).drop("i")


def with_equity(daily: DataFrame, cash: float = 100_000.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Compounded equity, kept in logs so long histories cannot overflow.

    ``log_growth`` is the log of the absolute growth and ``sign`` its sign; a
    return below -1 flips the sign exactly as a plain product would.
    """
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    growth = 1.0 + F.col("net_ret")
    flips = F.sum((growth < 0).cast("int")).over(upto)
    wiped = F.max((growth == 0).cast("int")).over(upto)
    logs = F.sum(F.when(growth != 0, F.log(F.abs(growth))).otherwise(0.0)).over(upto)
    df = daily.select(
        "*",
        logs.alias("log_growth"),
        F.when(wiped == 1, 0).when(flips % 2 == 1, -1).otherwise(1).alias("sign"),
    )
    return df.withColumn("equity", cash * F.col("sign") * F.exp("log_growth"))


def drawdowns(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equity over its running peak, minus 1, computed from the logs."""
    upto = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(F.when(F.col("sign") > 0, F.col("log_growth"))).over(upto)
    return daily.withColumn("drawdown", F.col("sign") * F.exp(F.col("log_growth") - peak) - 1.0)


def metrics(daily: DataFrame, by: tuple[str, ...] = (), benchmark: DataFrame | None = None) -> DataFrame:
    """One row (per group) of performance figures over daily net returns."""
    df = drawdowns(daily, by)
    # one row per date and group, so the quantile can ride along as a window
    df = df.withColumn("_cut", F.percentile("net_ret", F.lit(0.05)).over(Window.partitionBy(*by)))
    if benchmark is not None:
        df = df.join(benchmark.select("date", F.col("ret").alias("_bench")), "date", "left")
    r, n = F.col("net_ret"), F.count("net_ret")
    losses = F.when(r < 0, r)
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    total = F.sum(F.when(1 + r != 0, F.log(F.abs(1 + r))).otherwise(0.0))
    sign = F.when(F.max((1 + r == 0).cast("int")) == 1, 0).when(F.sum((1 + r < 0).cast("int")) % 2 == 1, -1).otherwise(1)
    figures = {
        "n": n,
        "cagr": F.when(sign > 0, F.exp(total * TRADING_DAYS / n) - 1).when(sign == 0, -1.0),
        "annual_vol": F.coalesce(F.stddev_samp(r), F.lit(0.0)) * year,
        "sharpe": F.when(F.stddev_samp(r) > 0, F.avg(r) / F.stddev_samp(r) * year).otherwise(0.0),
        "sortino": F.when(F.count(losses) == 0, F.when(F.avg(r) > 0, float("inf")).otherwise(0.0))
        .when(F.stddev_samp(losses) > 0, F.avg(r) / F.stddev_samp(losses) * year)
        .otherwise(0.0),
        "max_drawdown": F.min("drawdown"),
        "hit_rate": F.avg((r > 0).cast("double")),
        "var_5pct": F.first("_cut"),
        "cvar_5pct": F.avg(F.when(r <= F.col("_cut"), r)),
        "total_turnover": F.sum("turnover"),
    }
    if benchmark is not None:
        x = r - F.coalesce("_bench", F.lit(0.0))
        figures["excess_annual"] = F.avg(x) * TRADING_DAYS
        figures["information_ratio"] = F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x) * year)
    out = df.groupBy(*by).agg(*[c.alias(k) for k, c in figures.items()])
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0))


def attribution(prices: DataFrame, weights: DataFrame, **limits) -> DataFrame:
    """Contribution and days held by ticker, from the executed weights."""
    returns, dates, used = used_weights(prices, weights, **limits)
    paid = used.join(dates, "i").join(returns, ["date", "ticker"])
    earned = paid.groupBy("ticker").agg(
        F.sum(F.col("weight") * F.col("ret")).alias("total_contribution"),
        F.count_if(F.abs("weight") > 1e-6).alias("days_held"),
    )
    names = weights.select("ticker").intersect(returns.select("ticker"))
    return names.join(earned, "ticker", "left").fillna(0)


def benchmark_returns(prices: DataFrame, benchmark: str) -> DataFrame:
    return returns_of(prices.filter(F.col("ticker") == benchmark)).select("date", "ret")


def compare_rules(prices: DataFrame, books: dict[str, DataFrame], **options) -> DataFrame:
    """Metrics of several rules side by side, one row per rule."""
    out = None
    for name, weights in books.items():
        row = metrics(daily_results(prices, weights, **options)).withColumn("rule", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
