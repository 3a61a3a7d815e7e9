"""Canonical schemas, as DDL strings."""

LANDED = (
    "source_type string, source_name string, landed_at timestamp, fetch_seq bigint, payload string"
)

LISTING = (
    "source_type string, source_name string, external_id string, source_url string,"
    " title string, company string, location string, description string,"
    " posted_at timestamp, payload string, fetch_seq bigint"
)
LISTING_COLUMNS = (
    "source_type", "source_name", "external_id", "source_url", "title", "company",
    "location", "description", "posted_at", "payload",
)

POSTING_COLUMNS = (
    "id", "title", "company", "location", "skills", "date_scraped",
    "source_url", "raw_description", "source_type",
)

COMPANY = "name string, hq string, board string, token string"
SKILL = "id string, category string, aliases array<string>"
PRICE = "model string, in_usd_per_mtok decimal(10,4), out_usd_per_mtok decimal(10,4)"

COMPENSATION = (
    "struct<min_amount: double, max_amount: double, currency: string,"
    " period: string, is_estimated: boolean>"
)
ELIGIBILITY = (
    "struct<min_years_experience: double, degree_required: boolean, french_required: boolean,"
    " is_new_grad_friendly: boolean, is_internship_or_coop: boolean, evidence: array<string>>"
)
VISA = (
    "struct<sponsorship_available: boolean, requires_existing_authorization: boolean,"
    " citizenship_or_pr_required: boolean, evidence: array<string>>"
)
COMPONENT_FIELDS = (
    ("title_raw", "string"),
    ("title_normalized", "string"),
    ("seniority", "string"),
    ("company_raw", "string"),
    ("company_canonical", "string"),
    ("skills", "array<string>"),
    ("skills_unmapped", "array<string>"),
    ("required_quals", "array<string>"),
    ("preferred_quals", "array<string>"),
    ("compensation", COMPENSATION),
    ("location_raw", "string"),
    ("city", "string"),
    ("region", "string"),
    ("country", "string"),
    ("remote_policy", "string"),
    ("eligibility", ELIGIBILITY),
    ("visa", VISA),
    ("posted_at", "date"),
    ("language", "string"),
    ("extraction_confidence", "double"),
)

POOL = "listing_id string, source string, title string, company string, raw_description string"
GOLD = (
    "schema_version int, listing_id string, source string, title string, company string,"
    " raw_description string, skills array<string>, annotator_model string,"
    " human_verified boolean, verification_method string,"
    " disagreement_with_baseline boolean, notes string, created_at timestamp"
)
