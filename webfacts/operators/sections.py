"""Rules over the sections of a page (one row per section)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.operators.aggregates import top_per_key


def cap_per_type(sections: DataFrame, page: str, kind: str, confidence: str, position: str, n: int) -> DataFrame:
    """At most ``n`` sections per page and type, the most confident ones; page order is kept by ``position``."""
    return top_per_key(sections, [page, kind], [F.desc(confidence), F.asc(position)], n)


def single_hero_footer(sections: DataFrame, page: str, position: str, top: str = "estimated_top", hero_limit: float = 30, footer_limit: float = 70) -> DataFrame:
    """One hero and one footer per page keep their type; other heroes become feature, other footers unknown.

    A hero must start in the upper part; a footer in the lower part or be a ``footer`` element, which wins
    over position and confidence. The picks are aggregates, so no page is brought to one task.
    """
    kind, conf = F.col("type"), F.col("confidence")
    is_tag = F.col("tag") == "footer"
    hero_ok = (kind == "hero") & (F.col(top) <= hero_limit)
    foot_ok = (kind == "footer") & F.col(top).isNotNull() & ((F.col(top) >= footer_limit) | is_tag)
    order = F.struct(conf, -F.col(position))
    picks = sections.groupBy(page).agg(
        F.max_by(position, F.when(hero_ok, order)).alias("_hero"),
        F.max_by(position, F.when(foot_ok, F.struct(is_tag, conf, -F.col(position)))).alias("_foot"),
    )
    out = sections.join(picks, page)
    lost_hero = (kind == "hero") & ~F.coalesce(F.col(position) == F.col("_hero"), F.lit(False))
    lost_foot = (kind == "footer") & ~F.coalesce(F.col(position) == F.col("_foot"), F.lit(False))
    new_type = F.when(lost_hero, "feature").when(lost_foot, "unknown").otherwise(kind)
    new_conf = F.when(lost_hero | lost_foot, F.greatest(F.lit(0.1), conf - 0.1)).otherwise(conf)
    return out.withColumns({"type": new_type, "confidence": new_conf}).drop("_hero", "_foot")


def section_height(headings: Column, paragraphs: Column, images: Column, buttons: Column) -> Column:
    return F.greatest(F.lit(50), headings * 40 + paragraphs * 60 + images * 200 + buttons * 40)


def with_offsets(sections: DataFrame, page: str, position: str, height: str = "height") -> DataFrame:
    """``start_y`` = heights above, ``estimated_top`` = its share of the page in percent, at most 100."""
    # all sections of a page come from one page row, so a window per page is bounded by it
    w = Window.partitionBy(page)
    above = w.orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    rows = sections.withColumns({"start_y": F.coalesce(F.sum(height).over(above), F.lit(0)), "_total": F.sum(height).over(w)})
    share = F.when(F.col("_total") > 0, F.least(F.lit(100.0), F.col("start_y") * 100 / F.col("_total"))).otherwise(0.0)
    return rows.withColumn("estimated_top", share).drop("_total")


def relabel_by_context(sections: DataFrame, page: str, position: str) -> DataFrame:
    """Correct section types from their place on the page and their neighbours.

    Input columns: type, confidence, tag, n_links, n_headings, n_images, n_buttons, has_h1, has_copyright.
    Only one rule looks at the corrected section before it ("a similar section after a feature is a feature").
    Such a section copies the feature state, so the chain is a last-known-value scan over the sections that
    decide for themselves.
    """
    w = Window.partitionBy(page)
    in_order = w.orderBy(position)
    rows = sections.withColumns({"_i": F.row_number().over(in_order), "_n": F.count(F.lit(1)).over(w)})
    kind, conf, i, n = F.col("_t"), F.col("_c"), F.col("_i"), F.col("_n")
    headline = F.col("has_h1") & (F.col("n_buttons") > 0)

    def apply(df: DataFrame, when: Column, new: Column | str, at_least: Column | float) -> DataFrame:
        label = F.lit(new) if isinstance(new, str) else new
        floor = F.lit(at_least) if isinstance(at_least, float) else at_least
        return df.withColumns({"_t": F.when(when, label).otherwise(kind), "_c": F.when(when, F.greatest(conf, floor)).otherwise(conf)})

    weak = (kind == "unknown") | (conf < 0.5)
    df = rows.withColumns({"_t": F.col("type"), "_c": F.col("confidence").cast("double")})
    opening = F.when(F.col("n_links") >= 3, "navigation").when(headline, "hero")
    df = apply(df, (i == 1) & weak & opening.isNotNull(), opening, 0.6)
    df = df.withColumn("_c", F.when((i == 1) & kind.isin("navigation", "hero"), F.least(conf * 1.1, F.lit(1.0))).otherwise(conf))
    # the second section looks at the first one only; the first one does not depend on others
    df = df.withColumn("_nav", F.first(kind == "navigation").over(in_order))
    df = apply(df, (i == 2) & F.col("_nav") & (kind == "unknown") & headline, "hero", 0.7)
    closing = F.when(F.col("has_copyright"), 0.8).when(F.col("tag") == "footer", 0.9)
    df = apply(df, (i == n) & weak & closing.isNotNull(), "footer", closing)
    df = df.withColumn("_c", F.when((i == n) & (kind == "footer"), F.least(conf * 1.1, F.lit(1.0))).otherwise(conf))

    may_copy = (i > 1) & (i < n) & ((F.col("n_headings") >= 2) | (F.col("n_images") >= 2)) & weak
    df = df.withColumn("_copy", may_copy)
    place = (i - 1) / F.greatest(n - 1, F.lit(1))
    tail = (
        F.when(place <= 0.15, F.when(F.col("n_links") >= 2, F.struct(F.lit("navigation").alias("t"), F.lit(0.4).alias("c"))))
        .when(place <= 0.3, F.when(headline, F.struct(F.lit("hero").alias("t"), F.lit(0.5).alias("c"))))
        .when(place <= 0.7, F.when(F.col("n_images") >= 3, F.struct(F.lit("feature").alias("t"), F.lit(0.4).alias("c"))))
        .when(place <= 0.9, F.when(F.col("n_buttons") > 0, F.struct(F.lit("cta").alias("t"), F.lit(0.4).alias("c"))))
        .otherwise(F.when(F.col("has_copyright") | (F.col("tag") == "footer"), F.struct(F.lit("footer").alias("t"), F.lit(0.6).alias("c"))))
    )
    df = df.withColumn("_tail", F.when((kind == "unknown") & (conf < 0.3), tail))
    alone = F.coalesce(F.col("_tail.t"), kind)
    decides = F.when(F.col("_copy") & (alone != "feature"), F.lit(None).cast("boolean")).otherwise(alone == "feature")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    scan = df.withColumn("_decides", decides).withColumn("_after_feature", F.last("_decides", ignorenulls=True).over(before))
    copied = F.col("_copy") & F.coalesce("_after_feature", F.lit(False))
    return scan.withColumns(
        {
            "type": F.when(copied, "feature").otherwise(alone),
            "confidence": F.when(copied, F.greatest(conf, F.lit(0.6))).otherwise(F.coalesce(F.col("_tail.c"), conf)),
        }
    ).drop("_i", "_n", "_t", "_c", "_nav", "_copy", "_tail", "_decides", "_after_feature")
