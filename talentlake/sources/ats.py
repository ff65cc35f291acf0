"""Rows of fifteen job-board platforms as raw postings: each a projection of landed JSON.

Fetching is left to whoever lands the pages; here one row is one posting, a JSON text.  An
expression of alternatives takes the first that is neither null nor empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.functions.parse import sap_date
from talentlake.functions.text import filled


@dataclass(frozen=True)
class Board:
    """JSON paths of a platform's fields; several are alternatives, lists of paths in ``place`` are joined."""

    id: tuple[str, ...]
    title: tuple[str, ...]
    url: tuple[str, ...]
    place: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    posted: tuple[str, ...] = ()
    joined: tuple[str, ...] = ()
    remote: str = ""
    clock: str = "iso"


#: Where each platform's API keeps a posting's fields.
BOARDS = {
    "greenhouse": Board(("id",), ("title",), ("absolute_url",), ("location.name",), ("content",), ("updated_at", "first_published")),
    "lever": Board(("id",), ("text",), ("hostedUrl",), ("categories.location",), ("descriptionPlain", "description"), ("createdAt",), clock="ms"),
    "ashby": Board(("id",), ("title",), ("jobUrl", "applyUrl"), ("location",), ("descriptionHtml", "descriptionPlain"), ("publishedAt", "updatedAt")),
    "workday": Board(("bulletFields[0]", "externalPath"), ("title",), ("externalPath",), ("locationsText",)),
    "smartrecruiters": Board(("id",), ("name",), ("ref", "applyUrl"), (), ("jobAd.sections.jobDescription.text", "jobAd.sections.jobDescription"), ("releasedDate", "createdOn"), ("location.city", "location.region", "location.country")),
    "bamboohr": Board(("id",), ("jobOpeningName",), ("jobOpeningUrl",), (), (), ("datePosted",), ("location.city", "location.state", "location.country"), "isRemote"),
    "teamtailor": Board(("id",), ("attributes.title",), ("links.careersite-job-url", "links.careersite-job-apply-url"), ("attributes.location",), ("attributes.body",), ("attributes.created-at",), remote="attributes.remote-status"),
    "recruitee": Board(("id",), ("title",), ("careers_url", "careers_apply_url"), (), ("description",), ("published_at", "created_at"), ("city", "country"), "remote"),
    "jobvite": Board(("eId", "id"), ("title",), ("jobUrl", "applyUrl"), ("location",), ("detail", "description"), ("date",)),
    "icims": Board(("id", "jobId"), ("jobTitle", "title"), ("url", "jobPostingUrl"), ("location",), ("description",), ("postedDate", "datePosted")),
    "oracle": Board(("Id", "RequisitionId"), ("Title",), ("RequisitionURL", "ExternalUrl"), ("PrimaryLocation",), ("ExternalDescriptionStr",), ("PostedDate",)),
    "successfactors": Board(("jobReqId", "jobPostingId"), ("jobTitle", "externalTitle"), ("postingUrl", "externalPostingUrl"), ("location",), ("jobDescription", "externalDescription"), ("postedDate", "postingStartDate"), clock="sap"),
    "comeet": Board(("uid",), ("name",), ("url_comeet_hosted_page", "url_active_page"), (), ("details",), ("time_updated", "date_updated"), ("location.city", "location.country")),
    "breezyhr": Board(("_id",), ("name",), ("url",), (), ("description",), ("published_date", "creation_date"), ("location.city", "location.country.name"), "location.is_remote"),
    "jazzhr": Board(("id",), ("title",), ("board_code_url", "apply_url"), (), ("description",), ("original_open_date", "open_date"), ("city", "state", "country_id")),
}


def _path(raw: Column, path: str) -> Column:
    """A field by dotted path, as text."""
    steps = "".join(f"['{p}']" if "[" not in p else f"['{p.split('[')[0]}'][{p.split('[')[1]}" for p in path.split("."))
    return F.get_json_object(raw, "$" + steps)


def raw_jobs(rows: DataFrame, platform: str, raw: str = "raw") -> DataFrame:
    """external_id, title, company, url, location, description, posted_at, raw and ats_type of landed rows.

    Rows without id, title or URL are left out.  ``company`` is taken from the column of that name.
    """
    b, j = BOARDS[platform], F.col(raw)
    first = lambda paths: filled(*[_path(j, p) for p in paths]) if paths else F.lit(None).cast("string")
    place = first(b.place)
    if b.joined:
        place = F.nullif(F.array_join(F.array_compact(F.array(*[F.nullif(_path(j, p), F.lit("")) for p in b.joined])), ", "), F.lit(""))
    if b.remote:
        place = F.when(_path(j, b.remote).isin("true", "fully"), F.lit("Remote")).otherwise(place)
    posted = first(b.posted)
    at = {"iso": F.replace(posted, F.lit("Z"), F.lit("+00:00")).try_cast("timestamp"), "ms": F.timestamp_millis(posted.try_cast("long")), "sap": sap_date(posted)}[b.clock]
    made = rows.select(
        first(b.id).alias("external_id"), first(b.title).alias("title"), "company", first(b.url).alias("url"), place.alias("location"),
        first(b.text).alias("description"), at.alias("posted_at"), j.alias("raw"), F.lit(platform).alias("ats_type"),
    )
    return made.where("external_id IS NOT NULL AND title IS NOT NULL AND url IS NOT NULL")


def oracle_items(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per posting from pages that nest them as items of lists."""
    items = F.from_json(F.get_json_object(raw, "$.items"), "array<struct<requisitionList:array<string>>>")
    return pages.withColumn(raw, F.explode(F.flatten(F.transform(items, lambda i: i["requisitionList"]))))
