"""Picture measurement over a long pixel table (image_id, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def luma() -> Column:
    return 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")


def tone(pixels: DataFrame) -> DataFrame:
    """Brightness, contrast, saturation and the shift to warm, each 0..1 (the shift -1..1)."""
    high, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    chroma = F.when(high == 0, 0.0).otherwise((high - low) / high)
    t = pixels.groupBy("image_id").agg(
        (F.avg(luma()) / 255).alias("brightness"), (F.stddev_pop(luma()) / 255).alias("contrast"), F.avg(chroma).alias("saturation"),
        (F.avg(F.col("r") - F.col("b")) / 255).alias("shift"),
    )
    return t.withColumn("temperature", F.when(F.col("shift") > 0.04, "warm").when(F.col("shift") < -0.04, "cool").otherwise("neutral"))


def sharpness(pixels: DataFrame) -> DataFrame:
    """1 - exp(-variance of the 4-neighbour Laplacian / 600) over the interior; 0 where an edge is under 3 pixels."""
    l = pixels.select("image_id", "x", "y", luma().alias("l"))
    row, col = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    n = l.withColumns({"a": F.lag("l").over(row), "b": F.lead("l").over(row)}).withColumns({"c": F.lag("l").over(col), "d": F.lead("l").over(col)})
    inner = n.where("a is not null and b is not null and c is not null and d is not null")
    v = inner.groupBy("image_id").agg(F.var_pop(F.col("a") + F.col("b") + F.col("c") + F.col("d") - 4 * F.col("l")).alias("v"))
    return pixels.select("image_id").distinct().join(v, "image_id", "left").select("image_id", F.coalesce(1 - F.exp(-F.col("v") / 600), F.lit(0.0)).alias("sharpness"))


def palette(pixels: DataFrame, colours: int = 6, apart: int = 72, buckets: int = 400) -> DataFrame:
    """(image_id, r, g, b, share): distinct colours of the commonest 4-bit buckets, then true means of what is nearest."""
    b4 = lambda c: F.floor(F.col(c) / 16).cast("int")
    hist = pixels.groupBy("image_id", b4("r").alias("r4"), b4("g").alias("g4"), b4("b").alias("b4")).agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), F.sum("g").alias("sg"), F.sum("b").alias("sb"))
    top = Window.partitionBy("image_id").orderBy(F.desc("n"), "r4", "g4", "b4")
    centre = F.struct((F.col("r4") * 17).alias("r"), (F.col("g4") * 17).alias("g"), (F.col("b4") * 17).alias("b"))
    ranked = hist.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= buckets)
    listed = ranked.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", centre.alias("c")))), lambda x: x["c"]).alias("cs"))
    d2 = lambda a, b: (a["r"] - b["r"]) * (a["r"] - b["r"]) + (a["g"] - b["g"]) * (a["g"] - b["g"]) + (a["b"] - b["b"]) * (a["b"] - b["b"])
    none = F.array().cast("array<struct<r:int,g:int,b:int>>")
    picked = F.aggregate("cs", none, lambda acc, c: F.when((F.size(acc) < colours) & ~F.exists(acc, lambda p: d2(p, c) < apart * apart), F.concat(acc, F.array(c))).otherwise(acc))
    centres = listed.select("image_id", F.posexplode(picked).alias("k", "c"))
    own = hist.withColumn("m", centre).join(centres, "image_id").withColumn("d", d2(F.col("m"), F.col("c")))
    near = Window.partitionBy("image_id", "r4", "g4", "b4").orderBy("d", "k")
    best = own.withColumn("rn", F.row_number().over(near)).where("rn = 1")
    sums = best.groupBy("image_id", "k").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(c) for c in "rgb"])
    share = F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))
    return sums.withColumn("share", share).where("share >= 0.005").select("image_id", *[F.round(F.col(c) / F.col("n")).cast("int").alias(c) for c in "rgb"], "share")


def signature(pixels: DataFrame, n: int = 4) -> DataFrame:
    """Tone, sharpness and the n largest colours as one row per image."""
    colours = palette(pixels)
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("share"), "r", "g", "b"))
    top = colours.withColumn("rn", rank).where(F.col("rn") <= n).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "r", "g", "b", "share"))), lambda c: F.struct(c["r"], c["g"], c["b"], c["share"])).alias("palette"))
    return tone(pixels).join(sharpness(pixels), "image_id").join(top, "image_id", "left")


def tone_line(s: DataFrame) -> DataFrame:
    """Light and contrast of a picture in words."""
    light = F.when(F.col("brightness") > 0.62, "Bright").when(F.col("brightness") < 0.32, "Dark").otherwise("Evenly lit")
    contrast = F.when(F.col("contrast") > 0.24, "high contrast").when(F.col("contrast") < 0.1, "low contrast").otherwise("soft")
    return s.select("image_id", F.concat_ws(" · ", light, contrast).alias("line"))


def hue_name(r: Column, g: Column, b: Column) -> Column:
    """One of twelve colour names by hue, saturation and lightness."""
    high, low = F.greatest(r, g, b) / 255, F.least(r, g, b) / 255
    light, d = (high + low) / 2, high - low
    sat = F.when(d == 0, 0.0).otherwise(d / (1 - F.abs(2 * light - 1)))
    third = F.when(F.greatest(r, g, b) == r, F.pmod((g - b) / 255 / d, F.lit(6.0))).when(F.greatest(r, g, b) == g, (b - r) / 255 / d + 2)
    hue = F.when(d == 0, 0.0).otherwise(third.otherwise((r - g) / 255 / d + 4) * 60)
    # Where one colour name ends and the next begins, in degrees.
    bands = [(15, "red"), (45, "orange"), (70, "yellow"), (165, "green"), (200, "teal"), (255, "blue"), (290, "purple"), (345, "pink")]
    named = F.when(hue.between(15, 44.999999) & (light < 0.45), "brown")
    for upto, name in bands:
        named = named.when(hue < upto, name)
    named = named.otherwise("red")
    return F.when(light < 0.13, "black").when((light > 0.9) & (sat < 0.18), "white").when(sat < 0.13, "grey").otherwise(named)


def colour_share(colours: DataFrame) -> DataFrame:
    """(image_id, colour, confidence): a third of the picture is full confidence."""
    named = colours.withColumn("colour", hue_name(F.col("r"), F.col("g"), F.col("b")))
    return named.groupBy("image_id", "colour").agg(F.least(F.sum("share") / 0.33, F.lit(1.0)).alias("confidence"))


# Words for what can be measured, by what they say.
WORDS = {
    "dark": "dark dim darkened night nighttime moody shadowy underexposed",
    "bright": "bright brightly sunny luminous overexposed",
    "colourful": "colourful colorful vibrant saturated neon bold",
    "muted": "muted desaturated monochrome greyscale grayscale washed",
    "warm": "warm golden amber cosy cozy",
    "cool": "cool cold icy frosty wintry",
    "high contrast": "contrasty contrast dramatic punchy",
    "low contrast": "flat faded pale hazy",
    "detailed": "sharp crisp detailed detail tacksharp",
    "soft": "blurry blurred soft unfocused outoffocus smudged",
    "wide": "wide landscape panorama panoramic horizontal widescreen",
    "tall": "tall portrait vertical upright",
    "square": "square",
    "large": "huge big large giant massive enormous",
    "small": "tiny small little thumbnail",
    "from today": "today",
    "from yesterday": "yesterday",
    "blue": "blue bluish navy azure", "red": "red reddish crimson scarlet", "green": "green greenish emerald",
    "yellow": "yellow yellowish gold golden", "orange": "orange orangey amber", "purple": "purple purpley violet indigo lavender",
    "pink": "pink pinkish magenta rose", "teal": "teal turquoise cyan aqua", "brown": "brown brownish tan beige sepia",
    "black": "black blackish", "white": "white whiteish whitish", "grey": "grey gray greyish grayish silver",
}
COLOURS = list(WORDS)[-12:]


def descriptors(files: DataFrame, signatures: DataFrame, now: Column) -> DataFrame:
    """(file_id, says, confidence): what measurements (or, without them, the description) say of each file.

    Needs file_id, width, height, bytes, created_at, description; signatures as of signature(), keyed by image_id.
    """
    j = files.select("file_id", "width", "height", "bytes", "created_at", F.lower("description").alias("said")).join(
        signatures.withColumnRenamed("image_id", "file_id").withColumn("measured", F.lit(True)), "file_id", "left"
    )
    c = F.col
    none = c("measured").isNull()
    step = lambda *rungs: F.coalesce(*[F.when(cond, v) for cond, v in rungs], F.lit(0.0))
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    told = lambda text: (none & c("said").contains(text), 0.8)
    ratio = c("width") / F.when(c("height") > 0, c("height"))
    midnight = F.date_trunc("day", now)
    day = F.expr("interval 1 day")
    claims = {
        "dark": step((c("brightness") < 0.32, 1.0), (c("brightness") < 0.42, 0.5), told("dark")),
        "bright": step((c("brightness") > 0.62, 1.0), (c("brightness") > 0.52, 0.5), (none & ~c("said").contains("dark") & c("said").contains("bright"), 0.8)),
        "colourful": clip(c("saturation") / 0.45),
        "muted": clip((0.2 - c("saturation")) / 0.2),
        "warm": clip(c("shift") / 0.08),
        "cool": clip(-c("shift") / 0.08),
        "high contrast": step((c("contrast") > 0.24, 1.0), (c("contrast") > 0.16, 0.5), told("high contrast")),
        "low contrast": step((c("contrast") < 0.1, 1.0), (none & ~c("said").contains("high contrast") & c("said").contains("low contrast"), 0.8)),
        "detailed": clip(c("sharpness") / 0.5),
        "soft": clip((0.2 - c("sharpness")) / 0.2),
        "wide": step((ratio >= 1.6, 1.0), (ratio >= 1.2, 0.6)),
        "tall": step((ratio <= 0.62, 1.0), (ratio <= 0.85, 0.6)),
        "square": step(((ratio > 0.92) & (ratio < 1.08), 1.0)),
        "large": step((c("width") * c("height") > 8_000_000, 1.0), (c("bytes") > 8 << 20, 0.8), (c("bytes") > 2 << 20, 0.4)),
        "small": step((c("bytes") < 150 << 10, 1.0), (c("bytes") < 400 << 10, 0.5)),
        "from today": step((c("created_at") >= midnight, 1.0)),
        "from yesterday": step(((c("created_at") >= midnight - day) & (c("created_at") < midnight), 1.0)),
    }
    empty = F.array().cast("array<struct<r:int,g:int,b:int,share:double>>")
    for colour in COLOURS:
        own = F.filter(F.coalesce("palette", empty), _is_colour(colour))
        share = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["share"])
        claims[colour] = F.least(share / 0.33, F.lit(1.0))
    pairs = F.array(*[F.struct(F.lit(w).alias("says"), F.coalesce(v.cast("double"), F.lit(0.0)).alias("confidence")) for w, v in claims.items()])
    return j.select("file_id", F.inline(F.filter(pairs, lambda x: x["confidence"] > 0)))


def _is_colour(name: str):
    return lambda p: hue_name(p["r"], p["g"], p["b"]) == name


def shape(files: DataFrame) -> DataFrame:
    ratio = F.col("width") / F.col("height")
    kind = F.when(ratio > 1, "landscape").when(ratio < 1, "portrait").when(ratio.isNotNull(), "square")
    return files.select("file_id", F.round(ratio, 2).alias("aspect"), kind.alias("orientation"))


def pick_still(frames: DataFrame) -> DataFrame:
    """Of the frames (video_id, image_id, contrast) the one with most contrast."""
    return frames.groupBy("video_id").agg(F.max_by("image_id", F.struct("contrast", -F.col("image_id"))).alias("image_id"))
