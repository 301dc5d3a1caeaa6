"""Replies of vision-language models: text to score, reasoning and file name, in three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.images import strip

MODES = ("batch", "sync", "local")
NO_REASONING = "No reasoning provided"


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once for each row, whoever reads them and whatever is filtered on them later."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def unfenced(stripped: Column) -> Column:
    """A stripped reply without an opening ```json and a closing ```; a bare opening fence stays."""
    begin = F.when(stripped.startswith("```json"), 8).otherwise(1)
    left = F.length(stripped) - begin + 1
    return strip(F.substring(stripped, begin, F.when(stripped.endswith("```") & (left >= 3), left - 3).otherwise(left)))


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def as_number(v: Column) -> Column:
    """What a float conversion accepts: numbers, true and false, and text of a number; else null."""
    kind, text = F.schema_of_variant(v), v.try_cast("string")
    boolean = F.when(text == "true", 1.0).otherwise(0.0)
    return F.when(kind == "BOOLEAN", boolean).when(kind == "STRING", strip(text).try_cast("double")).when((kind != "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), text.try_cast("double"))


def parse_responses(replies: DataFrame, mode: str, reply: str = "reply", path_name: str = "image_filename") -> DataFrame:
    """Adds score, reasoning, returned_filename, success and failure_kind to each reply.

    batch: the file name comes from the reply and is looked at first, whatever else is wrong with it; an empty one is
    missing; scores outside 0-10 pass; sync: scores outside 0-10 fail, the name comes from the request; local: a missing
    score is a successful 0.0, missing reasoning has a standard text. In batch mode rows with a failure are those that
    the reference format leaves out.
    """
    if mode not in MODES:
        raise ValueError(mode)
    rows = staged(replies, _stripped=strip(F.col(reply)))
    rows = staged(rows, _text=unfenced(F.col("_stripped")))
    rows = staged(rows, _v=F.try_parse_json(F.when(F.col("_text") != "", F.col("_text"))))
    v = F.col("_v")
    rows = staged(
        rows,
        _object=F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
        _score=member(v, "score"),
        _reasoning=member(v, "reasoning").isNotNull(),
        _said=F.try_variant_get(v, "$.reasoning", "string"),
        _name=F.try_variant_get(v, "$.image_filename", "string"),
    )
    rows = staged(rows, _number=as_number(F.col("_score")))
    fine = ~F.isnan("_number") & (F.abs("_number") < float("inf"))
    rows = staged(rows, _kind=_failure(mode, F.when(fine, F.col("_number"))))
    ok = F.col("_kind").isNull()
    value = F.coalesce("_number", F.lit(0.0)) if mode == "local" else F.col("_number")
    reasoning = F.coalesce("_said", F.lit(NO_REASONING)) if mode == "local" else F.col("_said")
    failed = F.lit(0.0) if mode == "sync" else F.lit(None).cast("double")
    if mode == "batch":
        returned = F.when(F.col("_object") & (F.col("_name") != ""), F.col("_name"))
    else:
        returned = F.when(ok, F.col(path_name) if path_name in replies.columns else F.lit(None).cast("string"))
    return rows.select(
        *replies.columns,
        F.when(ok, value).otherwise(failed).alias("score"),
        F.when(ok, reasoning).alias("reasoning"),
        returned.alias("returned_filename"),
        ok.alias("success"),
        F.col("_kind").alias("failure_kind"),
    )


def _failure(mode: str, number: Column) -> Column:
    has_score = F.col("_object") & F.col("_score").isNotNull()
    failure = F.when(F.coalesce("_text", F.lit("")) == "", "empty").when(~F.col("_object"), "bad_json")
    if mode == "batch":
        failure = failure.when(F.coalesce("_name", F.lit("")) == "", "missing_filename")
    if mode != "local":
        failure = failure.when(~has_score, "missing_score")
    failure = failure.when(has_score & number.isNull(), "bad_score")
    if mode == "sync":
        failure = failure.when(~number.between(0, 10), "out_of_range")
    if mode != "local":
        failure = failure.when(~F.col("_reasoning"), "missing_reasoning")
    return failure


def build_requests(images: DataFrame, prompt: str, kind: str = "batch", model: str = "model", content: str = "content", filename: str = "image_filename") -> DataFrame:
    """A request a row as JSON text: the image in base64, the prompt with a note of the file name.

    kind: batch (contents and parts), generate (a list of images), chat (messages). Images without bytes are left out.
    """
    rows = images.where(F.col(content).isNotNull())
    data = F.base64(F.col(content))
    ask = F.concat(F.lit(prompt), F.lit("\n\nImage filename: "), F.col(filename))
    if kind == "batch":
        part = F.array(F.to_json(F.struct(ask.alias("text"))), F.to_json(F.struct(F.struct(F.lit("image/jpeg").alias("mime_type"), data.alias("data")).alias("inline_data"))))
        config = F.to_json(F.struct(F.lit(0.1).alias("temperature"), F.lit(300).alias("max_output_tokens")))
        request = F.concat(F.lit('{"contents":[{"parts":['), F.array_join(part, ","), F.lit(']}],"generation_config":'), config, F.lit("}"))
    elif kind == "generate":
        request = F.to_json(F.struct(F.lit(model).alias("model"), ask.alias("prompt"), F.array(data).alias("images"), F.lit(False).alias("stream"), F.struct(F.lit(0.1).alias("temperature"), F.lit(300).alias("num_predict")).alias("options")))
    elif kind == "chat":
        url = F.concat(F.lit("data:image/jpeg;base64,"), data)
        text_part = F.to_json(F.struct(F.lit("text").alias("type"), ask.alias("text")))
        image_part = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
        head = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0.1).alias("temperature"), F.lit(300).alias("max_tokens")))
        request = F.concat(F.left(head, F.length(head) - 1), F.lit(',"messages":[{"role":"user","content":['), text_part, F.lit(","), image_part, F.lit("]}]}"))
    else:
        raise ValueError(kind)
    return rows.select(*[c for c in images.columns if c != content], request.alias("request"))
