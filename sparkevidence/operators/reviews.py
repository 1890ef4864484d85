"""Plans that an owner reviews: what needs a decision, relocations, reprocessing, draft cleanup, activation and discovery. Each is a
join of request tables with inventories and an array of reasons why a row may not go ahead; without reasons it may."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkevidence.functions import text as T


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for c, n in rules]))


def slug(key: Column) -> Column:
    return F.lower(F.substring_index(key, "/", -1))


def reconcile(active: DataFrame, discovered: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, class, successor) of both sides' keys (key, content_hash): unchanged, changed, added, missing, or moved where a missing
    key's content is found under one added key only; successor is that key (or of several the least, class missing)."""
    a, d = active.select(key, F.col("content_hash").alias("old")), discovered.select(key, F.col("content_hash").alias("new"))
    both = a.join(d, key, "full_outer")
    added = both.where("old is null").groupBy(F.col("new").alias("old")).agg(F.min(key).alias("successor"), F.count(F.lit(1)).alias("_n"))
    both = both.join(added, "old", "left")
    kind = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull() & (F.col("_n") == 1), "moved").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    )
    return both.select(key, kind.alias("class"), F.when(F.col("new").isNull(), F.col("successor")).alias("successor"))


def review_queue(plan: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, class, successor, question) of the items of a reconciliation that an owner decides on."""
    ask = F.when(F.col("class") == "moved", "relocate").when(F.col("successor").isNotNull(), "choose_successor").otherwise("archive_or_keep")
    return plan.where(F.col("class").isin("missing", "moved")).select(key, "class", "successor", ask.alias("question"))


def relocation_plan(requests: DataFrame, active: DataFrame, discovered: DataFrame, key: str = "document_key") -> DataFrame:
    """requests (document_key, new_key) with moved_from, reasons and ready: the old key is active, the new one is discovered with the same
    content, no other active row has it, and no other request wants it."""
    a, d = active.select(key, F.col("content_hash").alias("_old")), discovered.select(F.col(key).alias("new_key"), F.col("content_hash").alias("_new"))
    taken = active.select(F.col(key).alias("new_key"), F.lit(True).alias("_taken")).distinct()
    wanted = requests.groupBy("new_key").agg(F.count(F.lit(1)).alias("_wanted"))
    rows = requests.join(a, key, "left").join(d, "new_key", "left").join(taken, "new_key", "left").join(wanted, "new_key")
    why = reasons((F.col("_old").isNull(), "old_key_not_active"), (F.col("_new").isNull(), "new_key_not_discovered"), (F.col("_old") != F.col("_new"), "content_differs"), (F.col("_taken"), "key_collision"), (F.col("_wanted") > 1, "requested_twice"))
    return rows.select(key, "new_key", F.col(key).alias("moved_from"), why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def reprocess_plan(targets: DataFrame, extracted: DataFrame, terms: DataFrame, key: str = "document_key") -> DataFrame:
    """targets (key, text) against what was extracted anew (key, text) and required terms (key, term): reasons are a key that is gone, no
    change, furniture that is left, and a required term that was lost."""
    new = extracted.select(key, F.col("text").alias("_new"))
    rows = targets.join(new, key, "left").join(terms.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("_terms")), key, "left")
    furniture = F.exists(F.split("_new", "\n"), lambda x: F.lower(F.btrim(x)).isin(*T.BOILERPLATE))
    lost = F.exists(F.coalesce("_terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("text"), F.lower(t)) & ~F.contains(F.lower("_new"), F.lower(t)))
    why = reasons((F.col("_new").isNull(), "key_not_extracted"), (F.col("_new") == F.col("text"), "nothing_changed"), (furniture, "boilerplate_left"), (lost, "required_term_lost"))
    return rows.select(key, why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def draft_cleanup_plan(docs: DataFrame, backup: DataFrame, drift: DataFrame) -> DataFrame:
    """Of each draft (document_id, document_key, status): reasons not to delete it. An active version of its key has to be there and in
    the backup (document_id), the draft too, and nothing of the key but the draft may have drifted (document_id)."""
    drafts = docs.where("status = 'draft'").select("document_id", "document_key")
    keyed = docs.join(backup.select("document_id", F.lit(True).alias("_saved")).distinct(), "document_id", "left").join(drift.select("document_id", F.lit(True).alias("_drifted")).distinct(), "document_id", "left")
    per = keyed.groupBy("document_key").agg(
        F.count_if(F.col("status") == "active").alias("_active"), F.count_if((F.col("status") == "active") & F.col("_saved")).alias("_saved_active"), F.count_if((F.col("status") != "draft") & F.col("_drifted")).alias("_drifted_rest")
    )
    rows = drafts.join(per, "document_key").join(backup.select("document_id", F.lit(True).alias("_saved")).distinct(), "document_id", "left")
    why = reasons((F.col("_active") == 0, "no_active_version"), (F.col("_active") > F.col("_saved_active"), "active_not_in_backup"), (F.col("_saved").isNull(), "draft_not_in_backup"), (F.col("_drifted_rest") > 0, "other_rows_drifted"))
    return rows.select("document_id", "document_key", why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def activation_policy(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """candidates (candidate_id, url, domain, preview, confirmed) with reasons and ready, against sources (domain) that may be activated."""
    rows = candidates.join(allowed.select("domain", F.lit(True).alias("_known")).distinct(), "domain", "left")
    why = reasons(
        (~F.lower("url").startswith("https://"), "not_https"), (F.col("url").rlike("[?#]"), "url_not_exact"), (T.url_domain(F.col("url")) != F.col("domain"), "domain_differs"), (F.col("_known").isNull(), "domain_not_allowed"), (F.col("preview") != "ready", "preview_not_ready"), (~F.col("confirmed"), "not_confirmed")
    )
    return rows.select("candidate_id", "domain", why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def discover_candidates(asked: DataFrame, known: DataFrame, results: DataFrame, screened: Column, score: Column) -> DataFrame:
    """(name, questions, page_id, url): for each service that questions (name) ask for and nobody knows (name), its best search result that
    the screen lets pass; results: (name, page_id, url)."""
    from sparkevidence.operators.catalog import unknown_services

    wanted = unknown_services(asked, known).groupBy("name").agg(F.count(F.lit(1)).alias("questions"))
    good = results.where(screened).withColumn("_score", score).groupBy("name").agg(F.max(F.struct("_score", (-F.col("page_id")).alias("p"), "url")).alias("b"))
    return wanted.join(good, "name", "left").select("name", "questions", (-F.col("b.p")).alias("page_id"), "b.url")


def verify_snapshot(snapshot: DataFrame, scopes: DataFrame, key: str = "document_key") -> DataFrame:
    """(key, reasons) of a discovered snapshot (key, content_hash): keys outside the scopes (prefix, the part before the first slash), keys
    that occur twice, hashes of a wrong size, keys that look like secrets."""
    count = snapshot.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max((F.length("content_hash") != 64).cast("int")).alias("_bad"))
    rows = count.withColumn("prefix", F.substring_index(key, "/", 1)).join(scopes.select("prefix", F.lit(True).alias("_in")).distinct(), "prefix", "left")
    why = reasons((F.col("_in").isNull(), "outside_scope"), (F.col("_n") > 1, "duplicate_key"), (F.coalesce("_bad", F.lit(1)) == 1, "bad_hash"), (T.contains_secret(F.col(key)), "secret_in_key"))
    return rows.select(key, why.alias("reasons"))


def archive_plan(missing: DataFrame, decisions: DataFrame, backup: DataFrame, active: DataFrame, key: str = "document_key") -> DataFrame:
    """missing (key, content_hash) with reasons and ready: the owner has decided for archiving (key, decision, successor), the backup (key,
    content_hash) holds the row as it is, and a named successor is active."""
    d = decisions.select(key, "decision", "successor")
    b = backup.select(key, F.col("content_hash").alias("_saved"))
    live = active.select(F.col(key).alias("successor"), F.lit(True).alias("_live")).distinct()
    rows = missing.join(d, key, "left").join(b, key, "left").join(live, "successor", "left")
    why = reasons((F.coalesce("decision", F.lit("")) != "archive", "not_decided"), (F.col("_saved").isNull(), "no_backup"), (F.col("_saved") != F.col("content_hash"), "backup_out_of_date"), (F.col("successor").isNotNull() & F.col("_live").isNull(), "successor_not_active"))
    return rows.select(key, "successor", why.alias("reasons"), (F.size(why) == 0).alias("ready"))


def glossary_plan(reviewed: DataFrame, existing: DataFrame, item: str = "item") -> DataFrame:
    """(item, term, action) of reviewed items (item, term, decision, edited): approved and edited ones are applied, unless their term is
    sensitive, in the glossary already (term), or that of an earlier item."""
    rows = reviewed.withColumn("_t", F.when(F.col("decision") == "edited", F.col("edited")).otherwise(F.col("term")))
    taken = rows.where(F.col("decision").isin("approved", "edited")).groupBy(F.lower("_t").alias("_k")).agg(F.min(item).alias("_first"))
    known = existing.select(F.lower("term").alias("_k"), F.lit(True).alias("_known")).distinct()
    rows = rows.withColumn("_k", F.lower("_t")).join(taken, "_k", "left").join(known, "_k", "left")
    action = (
        F.when(~F.col("decision").isin("approved", "edited"), "not_approved").when(T.contains_secret(F.col("_t")) | F.col("_t").rlike("[0-9]{4,}"), "sensitive").when(F.col("_known"), "known").when(F.col(item) > F.col("_first"), "duplicate").otherwise("apply")
    )
    return rows.select(item, F.col("_t").alias("term"), action.alias("action"))


def preview_states(candidates: DataFrame, pages: DataFrame, connected: DataFrame, least: int = 3) -> DataFrame:
    """(domain, pages, short, state) of candidates (domain): already_connected, failed without pages, needs_review with fewer than `least`
    or where a third of them says little, else ready. pages: (domain, chars); connected: (domain)."""
    counts = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("chars") < 500).alias("short"))
    rows = candidates.select("domain").distinct().join(counts, "domain", "left").na.fill(0, ["pages", "short"]).join(connected.select("domain", F.lit(True).alias("_on")).distinct(), "domain", "left")
    state = F.when(F.col("_on"), "already_connected").when(F.col("pages") == 0, "failed").when((F.col("pages") < least) | (F.col("short") * 3 > F.col("pages")), "needs_review").otherwise("ready")
    return rows.select("domain", "pages", "short", state.alias("state"))
