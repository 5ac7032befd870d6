"""Text forms of fact rows, as input for an embedding model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, col
from webfacts.functions.text import prefixed


def labelled(parts: dict[str, ColumnOrName], sep: str = ". ") -> Column:
    """``Label: value`` parts joined; missing and empty values leave no trace."""
    texts = []
    for label, c in parts.items():
        v = col(c).cast("string")
        texts.append(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{label}: "), v)))
    return F.concat_ws(sep, *texts)


def section_text() -> Column:
    """Columns of analysed sections: type, name, headings, n_images, n_buttons, n_links."""
    heads = F.array_join(F.transform(F.slice("headings", 1, 5), lambda h: h["text"]), ", ")
    return prefixed(
        labelled({"Section type": "type", "Name": "name", "Headings": heads, "Images": F.when(F.col("n_images") > 0, F.col("n_images")), "Buttons": F.array_join("buttons", ", "), "Links": F.when(F.col("n_links") > 0, F.col("n_links"))}),
        "passage",
    )


def background_text() -> Column:
    """Columns of background designs: design_type, selector, gradients, blur, layers, animated."""
    g = F.get("gradients", F.lit(0))
    gradient = F.concat_ws(", ", F.concat(g["type"], F.lit(" gradient")), F.concat(g["angle"].cast("int").cast("string"), F.lit("deg")), F.when(F.size(g["stops"]) > 0, F.concat(F.size(g["stops"]).cast("string"), F.lit(" color stops"))), F.when(g["repeating"], "repeating"))
    return prefixed(
        labelled(
            {
                "Background design type": F.replace("design_type", F.lit("_"), F.lit(" ")), "Selector": "selector", "Gradient": gradient,
                "Blur": F.when(F.col("blur") > 0, F.concat(F.col("blur").cast("string"), F.lit("px"))), "Layers": F.when(F.col("layers") > 1, F.col("layers")),
                "Animated": F.when(F.col("animated"), "yes"),
            }
        ),
        "passage",
    )


def motion_text() -> Column:
    """Columns of motion patterns: type, name, trigger, duration, easing, iterations, properties."""
    props = F.array_join(F.transform("properties", lambda p: p["name"]), ", ")
    return prefixed(
        labelled({"Animation type": "type", "Name": "name", "Trigger": "trigger", "Duration": F.concat(F.col("duration").cast("int").cast("string"), F.lit("ms")), "Easing": "easing", "Iterations": "iterations", "Properties": props}),
        "passage",
    )


def difference_text() -> Column:
    """Columns of a responsive summary: total and one count per category."""
    return prefixed(labelled({"Responsive differences": "total", "Categories": "categories", "Breakpoints": "breakpoints"}), "passage")


def describe_name(name: ColumnOrName, dictionary: dict[str, str]) -> Column:
    """``heroSection-main`` -> translated words joined by blanks; unknown words stay."""
    words = F.split(F.lower(F.trim(F.regexp_replace(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1 $2"), r"[-_\s]+", " "))), " ")
    table = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
