"""Entity schemas, required keys, closed value sets and the edge vocabulary."""

from __future__ import annotations

QUALITY = "struct<credibility:int, experimental_rigor:int, reproducibility:string, overall:double, rationale:string>"
PAPER_RELATIONS = "struct<cites:array<string>, builds_on:array<string>, supports:array<string>, contradicts:array<string>, extends:array<string>, similar_to:array<string>>"
FINDING_RELATIONS = "struct<supports:array<string>, contradicts:array<string>, extends:array<string>, uses:array<string>, similar_to:array<string>>"
PAPER = (
    "slug string, title string, authors array<string>, fields array<string>, publication_date string, ingested_date string, source_url string, "
    f"arxiv_id string, doi string, venue string, ingest_mode string, quality {QUALITY}, findings array<string>, relations {PAPER_RELATIONS}, "
    "type string, body string, sort_key string, raw_keys map<string,string>"
)
FINDING = (
    "slug string, statement string, source_paper string, source_ref string, fields array<string>, extracted_date string, finding_type string, "
    f"hedging string, relations {FINDING_RELATIONS}, type string, body string, sort_key string, raw_keys map<string,string>"
)
AUTHOR = "name string, affiliation string, orcid string, type string, sort_key string, raw_keys map<string,string>"
FIELD = "name string, parent_field string, type string, sort_key string, raw_keys map<string,string>"
EDGE = "level string, src string, etype string, dst string"
LOG = "ts string, action string, target string, note string"

#: Required keys (dotted), by entity.
REQUIRED = {
    "paper": [
        "type", "title", "slug", "authors", "fields", "publication-date", "ingested-date", "source-url",
        "quality.credibility", "quality.experimental-rigor", "quality.reproducibility", "quality.overall", "quality.rationale",
        "findings", "relations.cites", "relations.builds-on", "relations.supports", "relations.contradicts", "relations.extends", "relations.similar-to",
    ],
    "finding": [
        "type", "statement", "slug", "source-paper", "source-ref", "fields", "extracted-date", "finding-type", "hedging",
        "relations.supports", "relations.contradicts", "relations.extends", "relations.uses", "relations.similar-to",
    ],
    "author": ["type", "name"],
    "field": ["type", "name"],
}
#: Closed sets.
ENUMS = {
    "finding-type": ["empirical", "theoretical", "definitional"],
    "hedging": ["asserted", "hedged", "speculative"],
    "quality.reproducibility": ["code-released", "partial", "none"],
}
#: Finding edges, the two symmetric ones, and what each is called between papers.
EDGE_TYPES = ["supports", "contradicts", "extends", "uses", "similar-to"]
SYMMETRIC = ["contradicts", "similar-to"]
PAPER_EDGE = {"supports": "supports", "uses": "builds-on", "extends": "extends", "contradicts": "contradicts", "similar-to": "similar-to"}
PAPER_EDGE_TYPES = ["cites", "builds-on", "supports", "contradicts", "extends", "similar-to"]
#: Folders by entity, in the order in which a later one wins a slug.
FOLDERS = {"papers": "paper", "findings": "finding", "authors": "author", "fields": "field"}
#: Quality weights and the scores of reproducibility.
WEIGHTS, REPRODUCIBILITY = (0.5, 0.3, 0.2), {"code-released": 5, "partial": 3, "none": 1}
