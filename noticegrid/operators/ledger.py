"""Accounts: plans from billing events, referral bonuses, reviews, recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticegrid import vocab
from noticegrid.functions import dates
from noticegrid.functions.text import strip, text
from noticegrid.operators.common import first_per_key, rank_all, subtract_keys

COMPLETED = "checkout.session.completed"
PAID = "invoice.paid"
ENDED = ("customer.subscription.deleted", "customer.subscription.paused")


def plan_for(amount: Column | str) -> Column:
    a = F.col(amount) if isinstance(amount, str) else amount
    return F.when(a >= 10000, F.lit("annual")).otherwise(F.lit("monthly"))


def entitlements(events: DataFrame) -> DataFrame:
    """Current plan per customer.

    A checkout sets plan and identity, later payments renew it. A key belongs to an e-mail: an end
    revokes the key that the customer's e-mail holds at that moment, whichever customer it was issued to; a renewal
    after an end issues a valid key again.
    """
    at = F.struct("ts", "seq")
    is_done, is_paid, is_end = F.col("type") == COMPLETED, F.col("type") == PAID, F.col("type").isin(*ENDED)
    per = events.groupBy("customer").agg(
        F.max_by(F.struct(F.lower(text("email")).alias("email"), text("device").alias("device"), plan_for("amount_total").alias("plan")),
                 F.when(is_done, at)).alias("_p"),
        F.min(F.when(is_done, at)).alias("_first"), F.max(F.when(is_done, at)).alias("_done"),
        F.max(F.when(is_paid, at)).alias("_paid")).where("_first is not null")
    issued = F.greatest(F.col("_done"), F.when(F.col("_paid") > F.col("_first"), F.col("_paid")))
    rows = per.select("customer", "_p.*", "_first", issued.alias("_issued"))
    moves = (events.where(is_done | is_paid | is_end).select("customer", at.alias("_at"), is_end.alias("_end"))
             .join(rows.select("customer", "email", "_first"), "customer").where(F.col("_at") >= F.col("_first")))
    before = Window.partitionBy("email").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(~F.col("_end"), F.struct("customer", F.col("_at").alias("_issued"))), ignorenulls=True).over(before)
    ended = (moves.withColumn("_held", held).where(F.col("_end") & F.col("_held").isNotNull())
             .select("_held.*").distinct().withColumn("_over", F.lit(True)))
    term = F.when(F.col("plan") == "annual", F.lit(360)).otherwise(F.lit(30))
    return rows.join(ended, ["customer", "_issued"], "left").select(
        "customer", "email", "device", "plan", F.col("_issued.ts").alias("issued_at"),
        F.date_add(F.col("_issued.ts").cast("date"), term).alias("expires"), F.coalesce("_over", F.lit(False)).alias("revoked"))


def current_by_identity(plans: DataFrame, identity: str) -> DataFrame:
    """Latest key per e-mail or device."""
    rows = plans.where(text(identity) != "")
    return first_per_key(rows, [identity], [F.desc("issued_at"), F.col("customer")])


def bonus_days(redemptions: DataFrame, codes: DataFrame, plans: DataFrame, as_of: Column) -> DataFrame:
    """Bonus days and new expiry per e-mail from referrals.

    Unknown codes and self-referral do not count; each referred identity counts once, first
    valid redemption. Days are stacked on the later of now and the current expiry.
    """
    valid = (redemptions.withColumn("referred", F.lower(text("referred_email")))
             .join(codes.select("code", F.lower("email").alias("referrer")), "code")
             .where((F.col("referrer") == "") | (F.col("referrer") != F.col("referred")))
             .withColumn("ident", F.coalesce(F.nullif(F.col("referred"), F.lit("")), F.col("referred_device")))
             .where(text("ident") != ""))
    once = first_per_key(valid, ["ident"], [F.col("ts"), F.col("seq")])
    grants = once.select(F.explode(F.array(
        F.struct(F.col("referrer").alias("email"), F.lit(vocab.BONUS_DAYS_REFERRER).alias("days")),
        F.struct(F.col("referred").alias("email"), F.lit(vocab.BONUS_DAYS_REFERRED).alias("days")))).alias("g")).select("g.*")
    totals = grants.where("email <> ''").groupBy("email").agg(F.sum("days").cast("int").alias("bonus_days"))
    expiry = plans.where("email <> ''").groupBy("email").agg(F.max_by("expires", F.struct("issued_at", "customer")).alias("_e"))
    today = as_of.cast("date")
    return totals.join(expiry, "email", "left").select(
        "email", "bonus_days", F.date_add(F.greatest(F.coalesce("_e", today), today), F.col("bonus_days")).alias("expires"))


def account_summary(plans: DataFrame, trials: DataFrame, as_of: Column) -> DataFrame:
    """The admin counts: trials and keys, active and in total."""
    left = dates.trial_days_left("started", as_of)
    t = trials.where("started is not null").agg(F.count_if(left > 0).alias("active_trials"), F.count(F.lit(1)).alias("total_trials"))
    p = plans.agg(F.count_if(~F.col("revoked")).alias("active_subs"), F.count(F.lit(1)).alias("issued"), F.count_if("revoked").alias("revoked"))
    both = t.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def trial_list(trials: DataFrame, as_of: Column, days: int = vocab.TRIAL_DAYS) -> DataFrame:
    left = dates.trial_days_left("started", as_of, days)
    return trials.where("started is not null").select(
        "device", F.col("started").cast("date").alias("started"),
        F.date_add(F.col("started").cast("date"), days).alias("expires"), (left > 0).alias("active"), left.alias("days_left")
    ).orderBy(F.desc("expires"), "device")


def review_upsert(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Reviews after edits: one per user; a changed text, rating or name awaits approval again."""
    fields = ["rating", "quote", "display_name", "company"]
    fresh = first_per_key(new.where(F.col("rating").between(1, 5)), ["user_id"], [F.desc("seq")]).drop("seq")
    both = old.withColumn("_o", F.lit(True)).join(
        fresh.select("user_id", F.lit(True).alias("_n"), *[F.col(f).alias(f"_n_{f}") for f in fields]), "user_id", "full")
    edited = F.col("_n").isNotNull()
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"_n_{f}"))
    return both.select(
        "user_id", *[F.when(edited, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        F.when(F.col("_o").isNull() | (edited & changed), F.lit(False)).otherwise(F.col("approved")).alias("approved"),
        F.when(F.col("_o").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(edited, now).otherwise(F.col("updated_at")).alias("updated_at"))


def published_reviews(reviews: DataFrame, k: int = 6) -> DataFrame:
    """Newest approved reviews with a text, rating held to 1..5."""
    newest = reviews.where("approved").orderBy(F.desc("created_at"), "user_id").limit(k)
    return newest.where(F.trim(text("quote")) != "").select(
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("rating", F.lit(5)))).alias("rating"), "quote", "display_name", "company")


def clean_recipients(rows: DataFrame, suppressed: DataFrame, per_batch: int = vocab.RECIPIENTS_MAX) -> DataFrame:
    """All addresses of each campaign in the order of their first mention, with the batch they are sent in."""
    queued = rank_all(queued_recipients(rows, suppressed), ["campaign"], [F.floor(F.col("seq") / 65536)], [F.col("seq"), F.col("email")], "ord")
    return queued.withColumn("batch", F.ceil(F.col("ord") / per_batch))


def queued_recipients(rows: DataFrame, suppressed: DataFrame) -> DataFrame:
    addr = F.lower(strip("address"))
    asked = rows.select("campaign", "seq", addr.alias("email")).where(F.contains("email", F.lit("@")))
    once = first_per_key(asked, ["campaign", "email"], [F.col("seq")])
    return subtract_keys(once, suppressed.select(F.lower(strip("email")).alias("email")), ["email"])


def recipients_report(rows: DataFrame, suppressed: DataFrame, limit: int = vocab.RECIPIENTS_MAX) -> DataFrame:
    """Per campaign: asked, skipped as suppressed, queued in the first batch, and in later ones."""
    addr = F.lower(strip("address"))
    asked = rows.select("campaign", addr.alias("email")).where(F.contains("email", F.lit("@"))).distinct()
    listed = suppressed.select(F.lower(strip("email")).alias("email")).distinct().withColumn("_s", F.lit(True))
    per = asked.join(listed, "email", "left").groupBy("campaign").agg(
        F.count(F.lit(1)).alias("asked"), F.count("_s").alias("suppressed"))
    queue = F.col("asked") - F.col("suppressed")
    return per.select("campaign", "asked", "suppressed", F.least(queue, F.lit(limit)).alias("queued"),
                      F.greatest(queue - limit, F.lit(0)).alias("over_limit"))
