"""Schemas and fixed vocabularies of the graph tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = struct(path=S, query=S)
WEB_METADATA = struct(author=S, creator=S, description=S, favicon=S, image=S, language=S, locale=S, modified_time=S, published_time=S, site_name=S, tags=T.ArrayType(S), title=S, url=S)
SETTINGS = struct(only_extract_data_from_specified_links=B, only_crawl_direct_links_from_specified_links=B, only_crawl_within_domains_of_specified_links=B)
CLASSIFICATION = struct(is_relevant=B, reason=S, insight_if_classified_as_relevant=S)
ENTITY = struct(entity_name=S, matching_text=S, start=I, end=I, probability=T.FloatType())
NODES = struct(project_id=S, node_id=L, labels=T.ArrayType(S), payload_type=S, text=S, link=LINK, web_metadata=WEB_METADATA, settings=SETTINGS, classification=CLASSIFICATION, entities=T.ArrayType(ENTITY), flags=I, written_at=TS)
EDGES = struct(project_id=S, src=L, pos=I, dst=L, label=S, written_at=TS)
PARTS = struct(page_id=L, pos=I, parent_pos=I, kind=S, text=S, name=S, value=S)
SEARCH_RESULT = struct(title=S, url=S, description=S, age=S, language=S, page_age=S, family_friendly=B)
SEARCH_RESPONSE = struct(web=struct(type=S, results=T.ArrayType(SEARCH_RESULT)))
LLM_ENVELOPE = struct(id=S, content=T.ArrayType(struct(type=S, text=S)))
CRAWLER, CLASSIFIER = struct(keywords_to_get_accurate_results_from_web_search=T.ArrayType(S)), struct(prompt_to_classify_content_as_relevant_to_objective_or_not=S)
PLAN = struct(short_project_name_with_spaces=S, tools_needed_to_accomplish_objective=T.ArrayType(struct(Crawler=CRAWLER, Classifier=CLASSIFIER, NamedEntityExtraction=T.ArrayType(S))))

# Bits of a node's flags.
PROCESSED, REQUESTING, BLOCKED, HAD_ERROR = 1, 2, 4, 8
FLAG_NAMES = {PROCESSED: "IsProcessed", REQUESTING: "IsRequesting", BLOCKED: "IsBlocked", HAD_ERROR: "HadError"}
# An edge label and its inverse.
INVERSE = {
    "RelatedTo": "RelatedTo", "ParentOf": "ChildOf", "ChildOf": "ParentOf", "ContentOf": "PathOf", "PathOf": "ContentOf", "OwnerOf": "BelongsTo",
    "BelongsTo": "OwnerOf", "Suggests": "SuggestedFor", "SuggestedFor": "Suggests", "Classifies": "ClassifiedFor", "ClassifiedFor": "Classifies",
}
# Labels that a node can have.
NODE_LABELS = (
    "AddedByUser", "AddedByAI", "AddedByWebSearch", "AddedByGliner", "Objective", "DomainName", "Link", "RobotsTxt", "Content", "Heading", "Title", "Paragraph", "ListItem", "UnorderedPoints",
    "OrderedPoints", "Partial", "SearchTerm", "WebPage", "WebSearch", "WebMetadata", "CrawlCondition", "ProjectSettings", "CrawlerSettings", "ClassifierSettings", "Classification", "NamedEntitiesToExtract", "ExtractedNamedEntities",
)
# Labels that exploring a graph enters.
EXPLORED_LABELS = ("Objective", "ProjectSettings", "CrawlerSettings", "ClassifierSettings", "Link", "DomainName", "WebSearch")
# Labels that the workflow view starts from.
WORKFLOW_LABELS = ("Objective", "CrawlerSettings", "ProjectSettings", "WebSearch", "Link")
# Entity classes that can be asked for.
ENTITY_NAMES = ("Person", "Organization", "Date", "Place")
