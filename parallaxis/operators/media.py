"""Facts of media files as columns, and the ordered rules that admit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxis.functions.numeric import is_positive_fraction

# What marks high dynamic range, what counts as unknown, what audio is copied,
# the depths of well-known pixel formats, and the time bases tried in order.
HDR_TRANSFER = ("smpte2084", "arib-std-b67", "linear")
HDR_SPACE = ("bt2020nc", "bt2020c", "bt2020")
UNKNOWN = ("", "unknown", "unspecified", "reserved", "n/a")
AUDIO = ("aac", "mp3", "ac3", "eac3")
FORMAT_BITS = {
    8: ("nv12", "yuv420p", "yuvj420p"),
    10: ("p010", "p010le", "yuv420p10le", "yuv420p10be"),
    12: ("p012", "p012le", "yuv420p12le", "yuv420p12be"),
    16: ("p016", "p016le", "yuv420p16le", "yuv420p16be"),
}
TIME_BASES = (90000, 180000, 360000, 720000, 1000000)
# The encoders tried when none is named, best first; the widest frame of those
# that have a limit; what encodes a codec, best first; the range of both quality settings.
ENCODERS = ("hevc_nvenc", "h264_nvenc", "libx264")
WIDEST = {"h264_nvenc": 4096}
CODEC_ENCODERS = {"h264": ("h264_nvenc", "libx264"), "h265": ("hevc_nvenc", "libx265")}
QUALITY = (0, 51)


def clean_color(value: Column) -> Column:
    """Lower case without spaces; null for names of the unknown."""
    text = F.lower(F.trim(value))
    return F.when(~text.isin(*UNKNOWN), text)


def bit_depth_by_format(explicit: Column, pix_fmt: Column) -> Column:
    """A positive explicit number, else the well-known formats, else digits at the name's end, else 8."""
    name, given = F.lower(pix_fmt), explicit.try_cast("int")
    out = F.when(given > 0, given)
    for bits, names in FORMAT_BITS.items():
        out = out.when(name.isin(*names), bits)
    digits = F.regexp_extract(name, r"(\d+)(?:le|be)?$", 1).try_cast("int")
    return out.otherwise(F.coalesce(F.when(digits > 0, digits), F.lit(8)))


def bit_depth_by_name(explicit: Column, pix_fmt: Column) -> Column:
    """Explicit digits, else what number the name contains, else 8."""
    name = F.coalesce(F.lower(pix_fmt), F.lit(""))
    out = F.when(F.trim(explicit).rlike(r"^\d+$"), explicit.try_cast("int"))
    for bits in (10, 12, 16):
        out = out.when(name.contains(str(bits)), bits)
    return out.otherwise(8)


def rotation(tag: Column, side: Column) -> Column:
    """Side data over the tag, else 0; from 0 to 359."""
    return F.pmod(F.coalesce(side.try_cast("int"), tag.try_cast("int"), F.lit(0)), F.lit(360))


def frame_count(nb_frames: Column, duration: Column, fps: Column) -> Column:
    """Digits as given, else the rounded product (1 at least), else 0."""
    guess = F.greatest(F.lit(1), F.rint(duration * fps).cast("long"))
    return F.when(F.trim(nb_frames).rlike(r"^\d+$"), nb_frames.try_cast("long")).when((duration > 0) & (fps > 0), guess).otherwise(F.lit(0)).cast("long")


def is_hdr(bits: Column, transfer: Column, space: Column | None = None, primaries: Column | None = None) -> Column:
    """More than eight bits, or a name that stands for high dynamic range."""
    marks = [bits > 8, F.lower(transfer).isin(*HDR_TRANSFER), *[F.lower(c).isin(*HDR_SPACE) for c in (space, primaries) if c is not None]]
    out = F.lit(False)
    for m in marks:
        out = out | F.coalesce(m, F.lit(False))
    return out


def is_vfr(rate: Column, average: Column) -> Column:
    return F.coalesce(F.abs(rate - average) > 0.005, F.lit(False))


def codec_list(codecs: Column) -> Column:
    return F.filter(F.split(codecs, ","), lambda c: c != "")


def audio_admitted(codecs: Column) -> Column:
    """Whether every track can be copied (no track: yes)."""
    return F.forall(codec_list(codecs), lambda c: c.isin(*AUDIO))


def rejection(hdr: Column, vfr: Column, width: Column, height: Column, rotated: Column, sar: Column, codecs: Column) -> Column:
    """The first rule that rejects, in order; null if none does."""
    first = codec_list(codecs)
    square = F.coalesce(sar, F.lit("1:1")).isin("1:1", "0:1", "N/A")
    return (
        F.when(hdr, "hdr").when(vfr, "variable rate").when((width % 2 != 0) | (height % 2 != 0), "odd size")
        .when(rotated != 0, "rotated").when(~square, "pixel aspect").when((F.size(first) > 0) & ~F.try_element_at(first, F.lit(1)).isin(*AUDIO), "audio codec")
    )


def pts_base(num: Column, den: Column) -> Column:
    """The first time base in which a frame lasts whole ticks, or a common multiple up to ten million; else null."""
    from parallaxis.functions.numeric import gcd

    out = None
    for base in TIME_BASES:
        exact = (F.lit(base) * den) % num == 0
        out = F.when(exact, F.lit(base)) if out is None else out.when(exact, F.lit(base))
    multiple = F.expr("90000L") * (num / gcd(F.lit(90000), num)).cast("long")
    return out.when(multiple <= 10_000_000, multiple).cast("long")


def pts_increment(num: Column, den: Column) -> Column:
    base = pts_base(num, den)
    return (base * den / num).cast("long")


def encoder_choice(requested: Column, width: Column, available: Column) -> Column:
    """A named encoder or none; ``auto`` takes the first that is available and takes the width."""
    out = None
    for name in ENCODERS:
        fits = (width <= WIDEST.get(name, 1 << 30)) & F.array_contains(available, name)
        for condition in ((requested == "auto") & fits, (requested == name) & fits):
            out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def codec_encoder(codec: Column, requested: Column, available: Column) -> Column:
    """``encoder, problem`` for a codec: named ones must encode it and be available; else its first if available, its software one if not."""
    name = F.lower(F.trim(F.coalesce(requested, F.lit(""))))
    auto = name.isin("", "auto")
    encoder = problem = None
    for c, (hardware, software) in CODEC_ENCODERS.items():
        first = F.when(F.array_contains(available, hardware), hardware).otherwise(software)
        chosen = F.when(auto, first).when(name.isin(hardware, software) & F.array_contains(available, name), name)
        wrong = F.when(~auto & ~name.isin(hardware, software), "incompatible").when(~auto & ~F.array_contains(available, name), "unavailable")
        encoder = F.when(codec == c, chosen) if encoder is None else encoder.when(codec == c, chosen)
        problem = F.when(codec == c, wrong) if problem is None else problem.when(codec == c, wrong)
    return F.struct(encoder.alias("encoder"), problem.otherwise("unknown codec").alias("problem"))


def quality_allowed(crf: Column, cq: Column) -> Column:
    """Whether both quality settings are in their range."""
    return F.coalesce(crf.between(*QUALITY) & cq.between(*QUALITY), F.lit(False))


def bitrate_text(bits: Column) -> Column:
    """Megabits with up to three decimals and an ``M``."""
    return F.concat(F.regexp_replace(F.format_string("%.3f", bits.cast("double") / 1e6), r"\.?0+$", ""), F.lit("M"))


def url_allowed(url: Column, hosts: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """Encrypted, and a listed host or one below a listed suffix."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    ok = host.isin(*hosts)
    for s in suffixes:
        ok = ok | host.endswith("." + s)
    return F.coalesce((host != "") & ok, F.lit(False))


def content_range(header: Column) -> Column:
    """``bytes start-end/total`` as a struct; total null for ``*``; null if malformed."""
    pattern = r"^bytes (\d+)-(\d+)/(\d+|\*)$"
    part = lambda k: F.regexp_extract(header, pattern, k).try_cast("long")
    return F.when(header.rlike(pattern), F.struct(part(1).alias("start"), part(2).alias("end"), part(3).alias("total")))


def output_name(path: Column, suffix: str) -> Column:
    """A name with a suffix in front of its extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix), F.regexp_extract(path, r"(\.[^./]*)$", 1))


def admit(facts: DataFrame) -> DataFrame:
    """Adds bits, hdr, vfr, rotation and the reason of rejection to probe facts."""
    from parallaxis.functions.numeric import rate_or

    out = facts.withColumn("bits", bit_depth_by_name(F.col("raw_bits"), F.col("pix_fmt"))).withColumn("fps", rate_or(F.col("rate"))).withColumn("avg_fps", rate_or(F.col("average")))
    out = out.withColumn("hdr", is_hdr(F.col("bits"), F.col("transfer"), F.col("space"), F.col("primaries"))).withColumn("vfr", is_vfr(F.col("fps"), F.col("avg_fps"))).withColumn("rotation", rotation(F.col("rotate_tag"), F.col("rotate_side")))
    return out.withColumn("reason", rejection(F.col("hdr"), F.col("vfr"), F.col("width"), F.col("height"), F.col("rotation"), F.col("sar"), F.col("codecs")))


#: What is read of a probe's JSON; all values as text, as probes write numbers either way.
PROBE = (
    "streams array<struct<index string, codec_type string, codec_name string, width string, height string, r_frame_rate string, avg_frame_rate string, duration string, nb_frames string, "
    "pix_fmt string, color_space string, color_transfer string, color_primaries string, bits_per_raw_sample string, sample_aspect_ratio string, "
    "tags map<string, string>, side_data_list array<map<string, string>>>>, format struct<duration string>"
)


def probe_facts(documents: DataFrame, column: str) -> DataFrame:
    """Facts of media from a probe's JSON: the first video stream, and the codecs of all audio streams in order.

    ``unusable`` says why nothing can be done with it: no video stream, no size or no frame rate.
    A rate that is missing is taken from the other one, as :func:`admit` expects.
    """
    doc = documents.withColumn("_p", F.from_json(column, PROBE))
    streams = F.col("_p.streams")
    of = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    doc = doc.withColumn("_v", F.try_element_at(of("video"), F.lit(1))).withColumn("_a", of("audio"))
    value = lambda name: F.col(f"_v.{name}")
    named = lambda c: F.when(~F.lower(c).isin("0/0", "n/a", ""), c)
    rates = [F.when(is_positive_fraction(named(value(n))), value(n)) for n in ("r_frame_rate", "avg_frame_rate")]
    turned = F.filter(F.map_entries("_v.tags"), lambda e: F.lower(e["key"]).isin("rotate", "rotation"))
    side = F.filter(F.transform("_v.side_data_list", lambda m: m["rotation"].try_cast("double").cast("int")), lambda r: r.isNotNull())
    out = doc.select(
        *documents.columns,
        value("width").try_cast("int").alias("width"), value("height").try_cast("int").alias("height"),
        F.coalesce(*rates).alias("rate"), F.coalesce(rates[1], rates[0]).alias("average"), F.lower(value("pix_fmt")).alias("pix_fmt"),
        value("bits_per_raw_sample").alias("raw_bits"), value("color_transfer").alias("transfer"), value("color_space").alias("space"), value("color_primaries").alias("primaries"),
        F.try_element_at(turned, F.lit(1))["value"].try_cast("double").cast("int").cast("string").alias("rotate_tag"), F.try_element_at(side, F.lit(-1)).cast("string").alias("rotate_side"),
        value("sample_aspect_ratio").alias("sar"), F.array_join(F.transform("_a", lambda a: F.lower(F.coalesce(a["codec_name"], F.lit("unknown")))), ",").alias("codecs"),
        value("nb_frames").alias("nb_frames"), F.coalesce(value("duration").try_cast("double"), F.col("_p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration"),
        F.when(F.col("_v").isNull(), "no video stream").when(~F.coalesce((value("width").try_cast("int") > 0) & (value("height").try_cast("int") > 0), F.lit(False)), "no size").when(F.coalesce(*rates).isNull(), "no frame rate").alias("unusable"),
    )
    return out.withColumn("codecs", F.coalesce("codecs", F.lit("")))
