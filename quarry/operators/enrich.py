"""Enrichment: image header profiles, office properties, embedding hook,
image-text requests and responses, and their join-back into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.media import APP_PROPS, CORE_PROPS, image_profile  # noqa: F401


# ------------------------------------------------------------ image text

IMG_REF_RE = r"!\[[^\]]*\]\(([a-f0-9]{64})\)"


def inject_image_text(docs, image_texts, key: str, md_col: str = "markdown"):
    """Place each referenced image's text right after its reference:
    ``![](sha)<!--img:sha-->text<!--/img:sha-->``; unresolved refs stay.

    Only (doc key, ref) pairs and the image texts are shuffled: the distinct
    refs of each document are joined to the texts and folded into a small
    per-document map, which is joined back once and applied with a
    ``transform`` over the split markdown."""
    from ..functions.text import replace_each
    refs = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(md_col), F.lit(IMG_REF_RE), 1)))
                       .alias("sha256"))
    found = refs.join(image_texts.select("sha256", F.col("text").alias("_t")), "sha256")
    per_doc = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("sha256", "_t"))).alias("_m"))
    j = docs.join(per_doc, key, "left")

    def fix(ref):
        sha = F.regexp_extract(ref, IMG_REF_RE, 1)
        return F.concat(ref, F.lit("<!--img:"), sha, F.lit("-->"), F.col("_m")[sha], F.lit("<!--/img:"), sha, F.lit("-->"))
    out = F.when(F.col("_m").isNull(), F.col(md_col)).otherwise(replace_each(F.col(md_col), IMG_REF_RE, fix))
    return j.withColumn(md_col, out).drop("_m")


def attach_embeddings(chunks, vectors, key: str, dim: int):
    """Set the vector on chunk rows from a result table, keeping only vectors
    of the expected dimension."""
    v = vectors.filter(F.size("embedding") == dim)
    return chunks.join(v, key)


# ------------------------------------------------------------ office properties

def office_properties(parts):
    """``parts(sha256, path, xml)`` (docProps members of exploded OOXML files)
    → one row per file with the core and app properties, trimmed, blanks
    dropped (null).  A part is parsed once; a malformed one keeps its file with
    null properties."""
    def closed(xml):
        return xml.rlike(r"(?s)<([\w:.-]+)(?:\s[^>]*)?>.*</\1\s*>\s*$")

    def fields(path, props):
        schema = ", ".join(f"{el} string" for el, _ in props)
        one = parts.filter(F.col("path") == path).select(
            "sha256", F.from_xml(F.when(closed(F.col("xml")), F.col("xml")).otherwise(F.lit("<none/>")), schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("_x"))
        blank = [F.trim(F.col("_x")[el]) for el, _ in props]
        return one.select("sha256", *[F.when(v != "", v).alias(k) for v, (_, k) in zip(blank, props)])
    return fields("docProps/core.xml", CORE_PROPS).join(fields("docProps/app.xml", APP_PROPS), "sha256", "full")


# ------------------------------------------------------------ image text requests

def pending_images(images, responses):
    """Images still waiting for a model response (anti join on the hash)."""
    return images.join(responses.select("sha256"), "sha256", "left_anti")
