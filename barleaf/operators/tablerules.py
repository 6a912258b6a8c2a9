"""Rules kept in tables: flags, composite light, compliance, thresholds, cycles.

Requests, rules and prices meet in equi-joins; each verdict is a CASE over the
joined row, so adding requests only adds rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- flags --------------------------------------------------------------------

# The five flags, the share deployed under each light.
FLAGS = ("O", "F", "I", "C", "S")
DEPLOY = {"GREEN": 1.0, "YELLOW": 0.5, "RED": 0.25}


def oil_colour(last: Column, mean5: Column, mean20: Column, closed: Column | None = None, green_below: float = 85.0, red_above: float = 105.0) -> Column:
    """Red when the price and its 5-row mean pass the ceiling, green when low and
    under its 20-row mean."""
    held = F.coalesce(mean5, last)
    colour = (
        F.when((held > red_above) & (last > red_above), "RED")
        .when(last > red_above, "YELLOW")
        .when((last < green_below) & (last < mean20), "GREEN")
        .otherwise("YELLOW")
    )
    return F.when(closed, "RED").otherwise(colour) if closed is not None else colour


def policy_colour(last: Column, before: Column) -> Column:
    """Red after a rise, green after a cut, yellow on hold, unknown without data."""
    return (
        F.when(last.isNull(), "UNKNOWN")
        .when(last > F.coalesce(before, last) + 1e-9, "RED")
        .when(last < F.coalesce(before, last) - 1e-9, "GREEN")
        .otherwise("YELLOW")
    )


def inflation_colour(monthly_pct: Column, yearly_pct: Column, green: float = 0.2, red: float = 0.4, red_yearly: float = 5.0) -> Column:
    r = F.round(monthly_pct, 1)
    return F.when(yearly_pct > red_yearly, "RED").when(r >= red, "RED").when(r <= green, "GREEN").otherwise("YELLOW")


def tape_colour(level: Column, green_above: float = 30034.0, red_below: float = 28663.0) -> Column:
    return F.when(level > green_above, "GREEN").when(level < red_below, "RED").otherwise("YELLOW")


def series_readings(series: DataFrame, days_back: int = 75) -> DataFrame:
    """Per series at its newest date: last, 5 and 20 row means, the value 75 days
    earlier, and changes against 1 and 12 rows before."""
    by = Window.partitionBy("series_id").orderBy("date")

    def mean(n):
        return F.avg("value").over(by.rowsBetween(-(n - 1), 0))

    rows = series.filter("value is not null").select(
        "series_id", "date", "value", mean(5).alias("mean5"), mean(20).alias("mean20"),
        F.lag("value").over(by).alias("prior1"), F.lag("value", 12).over(by).alias("prior12"),
        F.max("date").over(Window.partitionBy("series_id")).alias("_last"),
    )
    early = F.col("date") <= F.date_sub("_last", days_back)
    newest = F.max_by(F.struct("date", "value", "mean5", "mean20", "prior1", "prior12"), "date").alias("_r")
    before = F.max_by(F.when(early, F.col("value")), F.when(early, F.col("date"))).alias("before")
    out = rows.groupBy("series_id").agg(newest, before).select("series_id", "_r.*", "before")
    return out.withColumn("change1_pct", (F.col("value") / F.col("prior1") - 1) * 100).withColumn("change12_pct", (F.col("value") / F.col("prior12") - 1) * 100)


def apply_overrides(readings: DataFrame, overrides: DataFrame, today: Column, max_age_days: int = 45) -> DataFrame:
    """A manual colour replaces the reading and is marked stale past its age."""
    o = overrides.filter(F.upper("color").isin("GREEN", "YELLOW", "RED", "UNKNOWN")).select(
        "flag", F.upper("color").alias("_forced"), F.col("as_of").alias("_as_of")
    )
    df = readings.join(o, "flag", "left")
    forced = F.col("_forced").isNotNull()
    return df.select(
        *[c for c in readings.columns if c not in ("color", "stale")],
        F.coalesce("_forced", "color").alias("color"),
        F.when(forced, "override").otherwise("live").alias("source"),
        F.coalesce(forced & (F.datediff(today, "_as_of") > max_age_days), F.lit(False)).alias("stale"),
    )


def composite(readings: DataFrame, by: str = "snapshot_at", green_min: int = 4, freeze: Sequence[str] = ("C", "S")) -> DataFrame:
    """One light per snapshot; a missing or unknown flag counts as yellow."""
    colour, known = F.col("color"), F.col("flag").isin(*FLAGS)
    counts = readings.filter(known).groupBy(by).agg(
        F.count_if(colour == "GREEN").alias("n_green"),
        F.count_if(colour == "RED").alias("n_red"),
        F.count_if(F.col("flag").isin(*freeze) & (colour == "RED")).alias("_frozen"),
    )
    light = F.when(F.col("n_red") > 0, "RED").when(F.col("n_green") >= green_min, "GREEN").otherwise("YELLOW")
    df = counts.withColumn("n_yellow", len(FLAGS) - F.col("n_green") - F.col("n_red")).withColumn("color", light)
    share = F.coalesce(*[F.when(F.col("color") == c, v) for c, v in DEPLOY.items()])
    return df.select(
        by, "n_green", "n_yellow", "n_red", "color", share.alias("deployment_fraction"),
        (F.col("_frozen") > 0).alias("semi_freeze"), (F.col("color") == "RED").alias("defensives_only"),
    )


def deployment_overlay(weights: DataFrame, names: DataFrame, light: DataFrame) -> DataFrame:
    """Scale buys by the deployed share; excluded names drop out with a reason.

    ``names`` has one row per ticker (never_buy, semi, defensive); ``light`` is
    one row and is read as scalars.
    """
    def now(c):
        return light.select(c).scalar()

    df = weights.join(names.select("ticker", "never_buy", "semi", "defensive"), "ticker", "left")
    buy = F.col("weight") > 0
    reason = (
        F.when(buy & F.coalesce("never_buy", F.lit(False)), "never-buy list")
        .when(buy & now("semi_freeze") & F.coalesce("semi", F.lit(False)), "semi freeze")
        .when(buy & now("defensives_only") & ~F.coalesce("defensive", F.lit(False)), "defensives only")
    )
    scaled = F.when(buy, F.col("weight") * now("deployment_fraction")).otherwise(F.col("weight"))
    return df.withColumn("dropped", reason).withColumn("weight", F.when(F.col("dropped").isNotNull(), 0.0).otherwise(scaled)).drop("never_buy", "semi", "defensive")


# -- portfolio ----------------------------------------------------------------


def portfolio_weights(holdings: DataFrame, prices: DataFrame, cash: float = 0.0) -> DataFrame:
    """Market value and share of the total per ticker; a holding without a live
    price is valued at its last known one."""
    lots = holdings.groupBy("ticker").agg(F.sum("qty").alias("qty"), F.max("last_price").alias("last_price"))
    df = lots.join(prices.select("ticker", "price"), "ticker", "left")
    df = df.withColumn("value", F.col("qty") * F.coalesce("price", "last_price"))
    whole = df.agg(F.sum("value")).scalar() + F.lit(cash)
    return df.select("ticker", "qty", "value", (100.0 * F.col("value") / whole).alias("weight_pct"))


def drawdown_from(baseline: float, weights: DataFrame) -> DataFrame:
    return weights.agg(F.sum("value").alias("invested")).withColumn("drawdown", 1.0 - F.col("invested") / baseline)


def cap_watch(weights: DataFrame, names: DataFrame, default_cap: float = 13.0, margin: float = 1.5) -> DataFrame:
    df = weights.join(names.select("ticker", "cap_pct"), "ticker", "left").withColumn("cap_pct", F.coalesce("cap_pct", F.lit(default_cap)))
    return df.filter(F.col("weight_pct") >= F.col("cap_pct") - margin).select(
        "ticker", "weight_pct", "cap_pct", (F.col("weight_pct") >= F.col("cap_pct")).alias("barred")
    )


def top_weights(weights: DataFrame, n: int = 8) -> DataFrame:
    return weights.orderBy(F.desc("weight_pct"), "ticker").limit(n).select("ticker", "weight_pct")


def upcoming(catalysts: DataFrame, today: Column, days: int = 14) -> DataFrame:
    return catalysts.filter(F.col("date").between(today, F.date_add(today, days)))


def realised_profit(fills: DataFrame) -> DataFrame:
    """(price - basis) * quantity of sells with a basis, by year."""
    pnl = (F.col("price") - F.col("avg_cost_basis")) * F.col("qty")
    sells = fills.filter("side = 'SELL' and avg_cost_basis is not null")
    return sells.groupBy(F.year("trade_date").alias("year")).agg(F.sum(pnl).alias("realized_pnl"), F.count("*").alias("n"))


def mark_to_market(positions: DataFrame, prices: DataFrame, cash: float, budget: float) -> DataFrame:
    df = positions.join(prices.select("ticker", "price"), "ticker", "left")
    worth = F.sum(F.col("shares") * F.coalesce("price", "entry_price"))
    return df.agg(worth.alias("deployed_mtm")).withColumn("equity", F.col("deployed_mtm") + cash).withColumn("return_pct", F.col("equity") / budget - 1)


def horizon_pnl(equity: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Return over 30, 91, 182 and 365 days against the last row on or before."""
    ref = as_of if as_of is not None else equity.agg(F.max("date")).scalar()
    marks = {"1m": 30, "3m": 91, "6m": 182, "1y": 365}
    aggs = [F.max_by("equity", "date").alias("_now")]
    for label, days in marks.items():
        old = F.col("date") <= F.date_sub(ref, days)
        aggs.append(F.max_by(F.when(old, F.col("equity")), F.when(old, F.col("date"))).alias(f"_{label}"))
    out = equity.agg(*aggs)
    return out.select(*[F.when(F.col(f"_{k}") > 0, F.col("_now") / F.col(f"_{k}") - 1).alias(f"pnl_{k}") for k in marks])


# -- pre-trade compliance -----------------------------------------------------


def check_trades(requests: DataFrame, names: DataFrame, weights: DataFrame, light: DataFrame, drawdown: DataFrame, min_score: float = 6.0, default_cap: float = 13.0, freeze_drawdown: float = 0.15) -> DataFrame:
    """Violations and warnings per request.

    ``names`` (one row per ticker) carries the lists, rating, price and 50-row
    mean; ``light`` and ``drawdown`` are single rows.
    """
    def yes(c):
        return F.coalesce(F.col(c), F.lit(False))

    df = requests.withColumn("ticker", F.upper("ticker")).withColumn("side", F.upper("side"))
    df = df.join(names.withColumn("ticker", F.upper("ticker")), "ticker", "left")
    df = df.join(weights.select(F.upper("ticker").alias("ticker"), "weight_pct"), "ticker", "left")
    df = df.withColumns(
        {
            "_defend": light.select("defensives_only").scalar(),
            "_freeze": light.select("semi_freeze").scalar(),
            "_down": drawdown.select("drawdown").scalar(),
        }
    )
    buy, sell, held = F.col("side") == "BUY", F.col("side") == "SELL", F.col("weight_pct").isNotNull()
    share, cap = F.coalesce("weight_pct", F.lit(0.0)), F.coalesce("cap_pct", F.lit(default_cap))
    cleared = F.coalesce((F.col("rating") > min_score) & (F.col("price") > F.col("sma50")), F.lit(False))
    broken = {
        "defensives only": buy & F.col("_defend") & ~yes("defensive"),
        "semi freeze": buy & F.col("_freeze") & yes("semi"),
        "never-buy list": buy & yes("never_buy"),
        "re-entry lockout": buy & yes("lockout") & ~cleared,
        "position cap": buy & (share >= cap),
        "drawdown semi freeze": buy & yes("semi") & (F.col("_down") > freeze_drawdown),
    }
    advised = {
        "cap tranche at 25%": buy & F.col("_defend") & yes("defensive"),
        "approaching cap": buy & (share < cap) & (share >= cap - 1.5),
        "no held position": sell & ~held,
        "hold-winner": sell & held & yes("hold_winner"),
    }

    def listed(cases):
        return F.filter(F.array(*[F.when(c, text) for text, c in cases.items()]), lambda v: v.isNotNull())

    out = df.withColumn("violations", listed(broken)).withColumn("warnings", listed(advised))
    return out.withColumn("allowed", F.size("violations") == 0).select(*requests.columns, "allowed", "violations", "warnings")


# -- standing thresholds ------------------------------------------------------

NEAR = 0.03
STATUS_ORDER = ("TRIGGERED", "NEAR", "AWAITING", "NO_DATA", "OK")


def standing_rules(rules: DataFrame, prices: DataFrame, events: DataFrame) -> DataFrame:
    """Status and action per (rule, ticker).

    ``rules``: ticker, kind, stop_below, trim_above, floor, sell_below,
    strength_lo, strength_hi, recovery_lo, recovery_hi, capitulation_below,
    event_key, event_sell_value, rating, rating_below.  ``events``: event_key,
    event_value.  Rules are the long side; prices join by ticker.
    """
    df = rules.join(prices.select("ticker", "price"), "ticker", "left").join(events.select("event_key", "event_value"), "event_key", "left")
    status, action = standing_verdict()
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    return df.select("ticker", "kind", "price", status.alias("status"), action.alias("action"), place.alias("place"))


def standing_verdict() -> tuple[Column, Column]:
    """Status and action of a row that holds a rule, a price and an event value."""
    c = F.col
    price = c("price")

    def near(level):
        return F.abs(price - c(level)) / c(level) <= NEAR

    told = c("event_key").isNotNull() & (c("event_value") == c("event_sell_value"))
    recovered = price >= c("recovery_lo")
    strong = price.between(c("strength_lo"), c("strength_hi"))
    cases = {
        "stop_and_trim": [(price < c("stop_below"), "TRIGGERED", "SELL ALL"), (price > c("trim_above"), "TRIGGERED", "TRIM 1/2"), (near("stop_below"), "NEAR", "STOP CLOSE")],
        "floor": [
            (price < c("floor"), "TRIGGERED", "SELL (hard floor)"), (told, "TRIGGERED", "SELL (event)"), (near("floor"), "NEAR", "FLOOR CLOSE"),
            (c("event_key").isNotNull() & c("event_value").isNull(), "AWAITING", "FLOOR"),
        ],
        "probation_band": [
            (price < c("sell_below"), "TRIGGERED", "SELL"), (strong, "TRIGGERED", "SELL into strength"),
            (told, "TRIGGERED", "SELL (event)"), (near("sell_below"), "NEAR", "SELL CLOSE"),
        ],
        "exit_band": [
            (recovered, "TRIGGERED", "SELL (recovery exit)"), (price < c("capitulation_below"), "TRIGGERED", "SELL (capitulation exit)"),
            (near("capitulation_below") | near("recovery_lo"), "NEAR", "EXIT CLOSE"),
        ],
        "event_kill_switch": [(c("event_value") == "true", "TRIGGERED", "SELL SAME DAY")],
        "rating_review": [(c("rating").isNull(), "NO_DATA", "REVIEW"), (c("rating") < c("rating_below"), "TRIGGERED", "REVIEW position")],
    }
    holds = c("kind").isin("hold", "hold_core", "hold_winner", "hold_accumulate")
    status, action = F.lit("OK"), F.lit("-")
    for kind, branches in cases.items():
        one, act = F.lit("OK"), F.lit("-")
        for condition, s, a in reversed(branches):
            one, act = F.when(condition, s).otherwise(one), F.when(condition, a).otherwise(act)
        mine = c("kind").isin("floor", "probation_floor") if kind == "floor" else c("kind") == kind
        status, action = F.when(mine, one).otherwise(status), F.when(mine, act).otherwise(action)
    blind = price.isNull() & ~holds & (c("kind") != "event_kill_switch")
    status = F.when(holds, "OK").when(blind, "NO_DATA").otherwise(status)
    action = F.when(holds, "HOLD").when(blind, "-").otherwise(action)
    return status, action


# -- dated conditional rules --------------------------------------------------


def cycle_rules(cycles: DataFrame, readings: DataFrame, light: Column, events: DataFrame, prices: DataFrame, weights: DataFrame, today: Column) -> DataFrame:
    """Status of every rule whose window holds today.

    ``cycles``: rule_id, start, end, flag, flag_allowed (array), bad_flag,
    flag_banned (array), composite_in (array), event_key, event_equals,
    guard_ticker, price_below, weight_ticker, weight_below and orders, an array
    of (ticker, dollars, min_price, max_price).  Null parts impose nothing.
    The first failing part names the status; orders outside their price guard
    stop the rule from firing.
    """
    live = cycles.filter(today.between(F.coalesce("start", today), F.coalesce("end", today)))
    tone = readings.select(F.col("flag"), F.col("color").alias("_c"))
    df = live.join(tone.select("flag", F.col("_c").alias("flag_color")), "flag", "left")
    df = df.join(tone.select(F.col("flag").alias("bad_flag"), F.col("_c").alias("bad_color")), "bad_flag", "left")
    df = df.join(events.select("event_key", "event_value"), "event_key", "left")
    df = df.join(prices.select(F.col("ticker").alias("guard_ticker"), F.col("price").alias("guard_price")), "guard_ticker", "left")
    df = df.join(weights.select(F.col("ticker").alias("weight_ticker"), F.col("weight_pct").alias("guard_weight")), "weight_ticker", "left")
    c = F.col
    unknown = c("flag_color").isNull() | (c("flag_color") == "UNKNOWN")
    status = (
        F.when(c("flag").isNotNull() & unknown, "AWAITING_EVENT")
        .when(c("flag").isNotNull() & ~F.array_contains("flag_allowed", c("flag_color")), "BLOCKED_FLAGS")
        .when(F.array_contains("flag_banned", c("bad_color")), "BLOCKED_FLAGS")
        .when(c("composite_in").isNotNull() & ~F.array_contains("composite_in", light), "BLOCKED_FLAGS")
        .when(c("event_key").isNotNull() & c("event_value").isNull(), "AWAITING_EVENT")
        .when(c("event_key").isNotNull() & (c("event_value") != c("event_equals")), "BLOCKED_FLAGS")
        .when(c("guard_ticker").isNotNull() & c("guard_price").isNull(), "AWAITING_EVENT")
        .when(c("guard_ticker").isNotNull() & (c("guard_price") >= c("price_below")), "BLOCKED_FLAGS")
        .when(c("weight_ticker").isNotNull() & (F.coalesce("guard_weight", F.lit(0.0)) >= c("weight_below")), "BLOCKED_FLAGS")
        .otherwise("OK")
    )
    df = df.select("rule_id", "orders", status.alias("_s"))
    legs = df.filter("_s = 'OK'").select("rule_id", F.explode("orders").alias("o")).select("rule_id", "o.*")
    legs = legs.join(prices.select("ticker", "price"), "ticker", "left")
    guarded = c("min_price").isNotNull() | c("max_price").isNotNull()
    fits = ~guarded | F.coalesce((c("price") >= F.coalesce("min_price", "price")) & (c("price") <= F.coalesce("max_price", "price")), F.lit(False))
    ok = legs.groupBy("rule_id").agg(F.every(fits).alias("_fits"), F.sum("dollars").alias("dollars"), F.count("*").alias("n_orders"))
    out = df.select("rule_id", "_s").join(ok, "rule_id", "left")
    final = F.when(c("_s") != "OK", c("_s")).when(~F.coalesce("_fits", F.lit(True)), "PRICE_GUARD").otherwise("FIRES")
    return out.select("rule_id", final.alias("status"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("dollars", F.lit(0.0)).alias("dollars"))
