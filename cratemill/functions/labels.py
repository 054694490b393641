"""Price labels: blends, caps, reference floors and ratio guardrails as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BlendConfig:
    """Parameters of the log-blend of a sold price and a listing floor, and of caps and guardrails."""

    w_base: float = 0.65
    tier_b_delta: float = 0.1
    tier_c_delta: float = 0.25
    w_min: float = 0.2
    w_max: float = 0.9
    gap_epsilon: float = 0.05
    gap_k_down: float = 0.2
    gap_k_up: float = 0.15
    gap_cap: float = 1.0
    listing_cap: float = 3.0
    label_cap_peak: float = 2.0
    label_cap_anchor: float = 4.0
    nowcast_cap: float = 15.0
    listing_clip: float = 2.0
    min_listing: float = 1.0
    inflated: float = 2.5
    mint_outlier: float = 3.0
    winsor: float = 4.0
    tolerance: float = 0.05
    full_strength: float = 0.5
    outlier_low: float = 4.0
    min_sales: int = 3


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def blend_weight(sold: Column, floor: Column, tier: Column, g: BlendConfig = BlendConfig()) -> Column:
    """The weight of the sold price: lower for weaker tiers, higher if listings lie below it, lower if above."""
    w = F.lit(g.w_base) - F.when(tier == "B", g.tier_b_delta).when(tier == "C", g.tier_c_delta).otherwise(0.0)
    gap = F.ln(floor) - F.ln(sold)
    step = F.when(gap < -g.gap_epsilon, g.gap_k_down * F.least(F.abs(gap), F.lit(g.gap_cap))).when(gap > g.gap_epsilon, -g.gap_k_up * F.least(gap, F.lit(g.gap_cap))).otherwise(0.0)
    return clip(clip(w, g.w_min, g.w_max) + step, g.w_min, g.w_max)


def blend(sold: Column, floor: Column, tier: Column, g: BlendConfig = BlendConfig()) -> Column:
    """exp of the weighted logs; one of them alone if the other is missing."""
    w = blend_weight(sold, floor, tier, g)
    return F.when((sold > 0) & (floor > 0), F.exp(w * F.ln(sold) + (1 - w) * F.ln(floor))).when(sold > 0, sold).when(floor > 0, floor)


def capped_listing(floor: Column, sold: Column, peak: Column, g: BlendConfig = BlendConfig()) -> Column:
    """A listing floor no higher than a multiple of what was paid; unchanged if nothing was."""
    base = F.when(sold > 0, F.greatest(sold, F.coalesce(peak, F.lit(0.0)))).when(peak > 0, peak)
    return F.least(floor, base * g.listing_cap)


def capped_label(y: Column, anchor: Column, peak: Column, g: BlendConfig = BlendConfig()) -> Column:
    return F.greatest(F.least(y, F.when(peak > 0, peak * g.label_cap_peak), F.when(anchor > 0, anchor * g.label_cap_anchor)), F.lit(1e-9))


def credible_listing(listing: Column, low: Column, high: Column, g: BlendConfig = BlendConfig()) -> Column:
    """A listing that is worth a look: not too cheap and inside the range of sales, if that is known."""
    return F.coalesce((listing >= g.min_listing) & (low.isNull() | (listing >= low)) & (low.isNull() | high.isNull() | (listing <= high)), F.lit(False))


def reference_floor(median: Column, average: Column, listing: Column, low: Column, high: Column, g: BlendConfig = BlendConfig()) -> Column:
    return F.greatest(F.when(median > 0, median), F.when(average > 0, average), F.when(credible_listing(listing, low, high, g), listing))


def spread_floor(median: Column, average: Column, listing: Column, low: Column, high: Column, g: BlendConfig = BlendConfig()) -> Column:
    """What the median is compared with: a credible listing, else a credible lowest sale, else the median itself."""
    left = average < median
    usable = (low > 0) & ~(left & (median / low > g.outlier_low))
    return F.when(credible_listing(listing, low, high, g), listing).when(usable, low).otherwise(median)


def ratio_guard(rung: Column, median: Column, average: Column, listing: Column, low: Column, high: Column, n: Column, g: BlendConfig = BlendConfig()) -> dict[str, Column]:
    """How far a grade's rung lies off what sales say: r_sale, r_ladder, direction (down, up, none) and strength (0 to 1).

    Without enough sales the fixed ratio of an inflated ladder stands in for r_sale.
    """
    ref = reference_floor(median, average, listing, low, high, g)
    enough = (median > 0) & (average > 0) & (n >= g.min_sales)
    floor = spread_floor(median, average, listing, low, high, g)
    left = average < median
    r_ladder = rung / ref
    r_sale = F.when(enough, median / floor * F.when(left, 1.0).otherwise(average / median)).otherwise(g.inflated)
    outlier = (low > 0) & (median / low > g.outlier_low)
    skip_down = F.coalesce(enough & (median / floor < 1) & (left | (outlier & credible_listing(listing, low, high, g))), F.lit(False))
    gap = r_ladder - r_sale
    down, up = (gap > 0) & (rung > ref) & ~skip_down, (gap < 0) & (rung < ref)
    usable = (ref > 0) & (rung > 0)
    direction = F.when(~F.coalesce(usable, F.lit(False)), "none").when(down, "down").when(up, "up").otherwise("none")
    base = F.when(direction == "down", r_ladder).otherwise(r_sale)
    strength = F.when((direction == "none") | (F.abs(gap) <= g.tolerance * base), 0.0).otherwise(clip(F.abs(gap) / base / g.full_strength, 0.0, 1.0))
    return {"reference": ref, "r_sale": r_sale, "r_ladder": r_ladder, "direction": direction, "strength": F.coalesce(strength, F.lit(0.0))}


def anchor_toward_reference(rung: Column, ref: Column, strength: Column, g: BlendConfig = BlendConfig()) -> Column:
    """The rung, moved towards the reference in logs by the blend weight times the strength."""
    w = blend_weight(rung, ref, F.lit("A"), g) * strength
    return F.when((strength > 0) & (ref > 0) & (rung > 0), F.exp(w * F.ln(ref) + (1 - w) * F.ln(rung))).otherwise(rung)


def trimmed_ladder(values: Column, nm: Column, g: BlendConfig = BlendConfig()) -> Column:
    """Rungs no higher than a multiple of near mint; mint rungs have a lower cap."""

    def cap(k: Column, v: Column) -> Column:
        mint = F.contains(F.lower(k), F.lit("mint")) & ~F.contains(F.lower(k), F.lit("near mint")) & ~F.contains(F.lower(k), F.lit("(nm"))
        return F.least(v, F.when(mint, nm * g.mint_outlier), nm * g.winsor)

    return F.transform_values(values, cap)


def interval(point: Column, lo: Column, hi: Column) -> Column:
    """struct(lo, hi) in cents around a price: bounds in order, the price between them; where rounding parts them, a cent is added."""
    low, high = F.least(lo, hi, point), F.greatest(lo, hi, point)
    l, h, p = (F.round(x, 2) for x in (low, high, point))
    return F.struct(F.when(p < l, F.greatest(F.lit(0.0), F.round(p - 0.01, 2))).otherwise(l).alias("lo"), F.when(p > h, F.round(p + 0.01, 2)).otherwise(h).alias("hi"))


def symmetric_interval(point: Column, half: Column) -> Column:
    """The price with half a width to either side, not below zero."""
    return interval(point, F.greatest(F.lit(0.0), point - half), point + half)


def heuristic_interval(point: Column, share: float = 0.12, least: float = 1.0) -> Column:
    """Without a model's residuals: a share of the price, a dollar at least, to either side."""
    return symmetric_interval(point, F.greatest(point * share, F.lit(least)))
