"""Storage options of a table: ``WITH (compression = 'zstd', zstd_level = 6, ...)``."""

from __future__ import annotations

DEFAULTS = {"compression": "zstd", "zstd_level": 6, "enable_dict": True, "dictionary_page_size_limit": 64 << 20}
CODECS = ("zstd", "snappy", "lz4_raw", "lz4", "gzip", "brotli", "uncompressed", "none")
ALIASES = {"dictionary_enabled": "enable_dict", "parquet_dictionary_enabled": "enable_dict", **{f"parquet_{k}": k for k in ("compression", "zstd_level", "gzip_level", "brotli_level", "dictionary_page_size_limit")}}
LEVELS = {"zstd": (1, 22), "gzip": (0, 9), "brotli": (0, 11)}
NAMES = ("compression", "zstd_level", "gzip_level", "brotli_level", "enable_dict", "dictionary_page_size_limit")
#: The file system library's names of the levels 0 to 9.
ZLIB = "NO_COMPRESSION BEST_SPEED TWO THREE FOUR FIVE SIX SEVEN EIGHT BEST_COMPRESSION".split()
TRUE, FALSE = ("1", "true", "t", "yes", "y", "on"), ("0", "false", "f", "no", "n", "off")


def parse_options(given: dict[str, str]) -> dict:
    """Checked options by their own names; ValueError for unknown ones, bad values, and levels of another codec."""
    out: dict = {}
    for key, raw in given.items():
        k = ALIASES.get(key.lower(), key.lower())
        if k not in NAMES:
            raise ValueError(f"{key!r} is no option of a table; there are {', '.join(NAMES)}")
        if k == "compression":
            out[k] = str(raw).lower()
            if out[k] not in CODECS:
                raise ValueError(f"{raw!r} is no codec; there are {', '.join(CODECS)}")
        elif k == "enable_dict":
            v = str(raw).strip().lower()
            if v not in TRUE + FALSE:
                raise ValueError(f"{key} is on or off, not {raw!r}")
            out[k] = v in TRUE
        else:
            try:
                out[k] = int(str(raw))
            except ValueError as e:
                raise ValueError(f"{key} is a whole number, not {raw!r}") from e
    codec = out.get("compression", "zstd")
    for name, (low, high) in LEVELS.items():
        level = out.get(f"{name}_level")
        if level is not None and name != codec:
            raise ValueError(f"{name}_level needs compression = '{name}', which is {codec!r}")
        if level is not None and not low <= level <= high:
            raise ValueError(f"{name}_level goes from {low} to {high}, so {level} is none")
    if out.get("dictionary_page_size_limit", 1) <= 0:
        raise ValueError("dictionary_page_size_limit has to be positive")
    return out


def writer_options(options: dict) -> dict[str, str]:
    """The same for Spark's Parquet writer."""
    o = DEFAULTS | options
    codec = o["compression"]
    if codec == "brotli":
        raise ValueError("the Parquet writer here has no brotli codec")
    out = {"compression": codec, "parquet.enable.dictionary": str(o["enable_dict"]).lower(), "parquet.dictionary.page.size": str(o["dictionary_page_size_limit"])}
    if codec == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(o["zstd_level"])
    if codec == "gzip" and "gzip_level" in o:
        out["zlib.compress.level"] = ZLIB[o["gzip_level"]]
    return out
