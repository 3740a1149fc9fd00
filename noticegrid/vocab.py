"""Term lists, tables, patterns and limits the rules are defined by.

All of these are parameters with defaults; the jobs take other lists as arguments.
"""

# ---- fixed values: trade vocabulary -------------------------------------------------
NICHE_TERMS = (
    "sidewalk", "side walk", "curb", "gutter", "concrete", "flatwork",
    "paving", "pavement", "ramp", "driveway", "apron", "trail", "greenway",
    "street improvement", "streetscape", "roadway", "road improvement",
    "intersection", "safe routes", "pedestrian", "walkway", "crosswalk",
    "parking lot", "slab", "curb ramp", "transition plan", "cdbg",
    "public works", "infrastructure", "reconstruction", "resurfacing",
)
STRONG_TERMS = (
    "sidewalk", "side walk", "curb", "gutter", "concrete", "flatwork",
    "paving", "pavement", "crosswalk", "driveway", "apron", "slab",
    "walkway", "curb ramp", "ada ramp",
)
UNRELATED_TERMS = (
    "janitorial", "insurance", "audit", "software", "banking", "uniform",
    "food service", "landscap", "mowing", "tree trimming", "fuel", "towing",
    "copier", "printing services", "legal services", "staffing", "security guard",
)
FIT_KEYWORDS = ("sidewalk", "ada ramp", "ada", "curb", "gutter", "concrete", "flatwork")
CONSTRUCTION_TERMS = (
    "sidewalk", "ada ramp", "curb ramp", "curb and gutter", "curb & gutter",
    "concrete", "flatwork", "pedestrian ramp",
)
TRADE_KEYWORDS = {
    "Roofing": ("roof", "shingle", "membrane", "gutter"),
    "Concrete / Paving": ("concrete", "asphalt", "paving", "sidewalk", "curb", "pavement"),
    "Roads / Sitework": ("road", "street", "grading", "excavation", "drainage", "storm",
                         "sewer", "water main"),
    "Building / Facility": ("building", "facility", "renovation", "remodel", "construction",
                            "addition", "repair"),
    "HVAC": ("hvac", "heating", "cooling", "air condition", "ventilation", "furnace",
             "boiler", "chiller", "rooftop unit", "rtu"),
    "Demolition": ("demolition", "demo", "removal", "clearing"),
    "General": (),
}

# ---- fixed values: status and award wording -----------------------------------------
CLOSED_STATUS_WORDS = (
    "closed", "close date", "awarded", "award to", "cancel", "expired", "withdrawn",
    "archived", "no longer", "not accepting", "complete", "planned", "upcoming",
    "anticipated",
)
AWARD_PHRASES = (
    "awarded the contract", "award the contract", "contract was awarded",
    "contract awarded", "was awarded to", "awarded to ", "winning bid",
    "winning bidder", "successful bidder", "apparent low bidder",
    "low bidder was", "bid was accepted", "council awarded",
    "commission awarded", "notice of award", "has been awarded",
)
OPEN_PHRASES = (
    "bids due", "bid due", "proposals due", "due date", "accepting bids",
    "now accepting", "sealed bids will be received", "will be received until",
    "bid opening", "submit bids", "submittal deadline", "closes on",
    "responses due", "questions due", "request for proposals due",
    "bids will be accepted", "deadline for bids",
)
PAGE_CLOSED_MARKERS = (
    "status: closed", "status:closed", "past due", "bidding is closed",
    "bidding has closed", "this solicitation is closed",
    "solicitation is closed", "no longer accepting", "submissions are closed",
    "closed to bidding", "bid is closed", "closed for bidding",
)

# ---- fixed values: hosts, platforms, paths ------------------------------------------
AGGREGATOR_DOMAINS = (
    "bidnetdirect.com", "demandstar.com", "publicpurchase.com", "planetbids.com",
    "questcdn.com", "opengov.com", "bonfirehub.com", "bidexpress.com",
    "bidsearch.com", "missouribuys.mo.gov", "sam.gov", "network.procore.com",
    "google.com", "bing.com", "duckduckgo.com",
)
PLATFORM_PATTERNS = (
    ("civicplus", r"civicplus\.com$|/bids\.aspx"),
    ("demandstar", r"demandstar\.com$"),
    ("planetbids", r"planetbids\.com$"),
    ("bonfire", r"bonfirehub\.com$"),
    ("opengov", r"opengov\.com$|procurement\.opengov\.com"),
    ("bidnetdirect", r"bidnetdirect\.com$"),
    ("questcdn", r"questcdn\.com$"),
    ("publicpurchase", r"publicpurchase\.com$"),
    ("bidexpress", r"bidexpress\.com$"),
)
CANDIDATE_PATHS = (
    "/Bids.aspx", "/bids", "/bids-and-rfps", "/purchasing", "/rfp", "/rfps",
    "/procurement", "/solicitations", "/bid-opportunities", "/bidopportunities",
    "/current-bids", "/open-bids", "/invitation-to-bid", "/notice-to-bidders",
    "/doing-business/bids", "/business/bids", "/departments/purchasing",
    "/departments/finance/purchasing", "/government/purchasing", "/purchasing/bids",
    "/finance/purchasing", "/RFP.aspx", "/Purchasing.aspx", "/bids.html",
)
CIVICPLUS_PATHS = (
    "/Bids.aspx", "/Bids.aspx?CatID=&txtSort=Date&showAllBids=on&Status=", "/rss.aspx",
)
CIVICPLUS_AUDIT_QUERY = "/Bids.aspx?catID=All&txtSort=Category&showAllBids=on"
CIVICPLUS_PAGE_MARKERS = ("bids.aspx", "bid postings")
LINK_HINTS = ("bid", "rfp", "rfq", "solicitation", "procurement", "purchasing", "vendor")
LINK_NOISE = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com",
    "linkedin.com", "mailto:", "tel:", "javascript:",
)
JUNK_HOST_PARTS = ("facebook.", "wikipedia.", "instagram.", "twitter.", "youtube.",
                   "tripadvisor.")
GENERIC_BID_TERMS = (
    "bid", "rfp", "rfq", "solicitation", "procurement", "purchasing",
    "notice to bidders", "invitation to bid", "request for proposal",
    "request for quote", "vendor registration", "open bids",
)
LOOSE_BID_MARKERS = ("bid", "rfp", "request for proposal", "solicitation", "procurement",
                     "invitation to")
STRONG_BID_MARKERS = (
    "invitation to bid", "invitation for bid", "request for proposal",
    "request for qualification", "sealed bid", "bid opportunit",
    "current bid", "open bid", "notice to bidder", "bid opening",
    "accepting bid", "bid document", "bid tabulation", "bids due",
    "request for bid", "bid packet", "solicitation", "procurement",
    "rfp", "rfq",
)
NOT_A_BID_PAGE = ("business improvement district",)

# ---- fixed values: contacts ---------------------------------------------------------
POSTING_JUNK_EMAIL = ("webmaster", "postmaster", "no-reply", "noreply", "donotreply",
                      "example.com", "sentry.io", "@2x", "civicplus.com")
PROSPECT_JUNK_EMAIL = (
    "example.com", "example.org", "yourdomain", "domain.com", "email.com",
    "sentry.io", "wixpress.com", "godaddy.com", "squarespace.com",
    "wordpress.com", "shopify.com", "cloudflare", "schema.org", "w3.org",
    "sentry-next", "@2x", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg",
    "@sentry", "no-reply", "noreply", "donotreply",
)
PROSPECT_JUNK_HOST = (
    "yelp.", "angi.", "bbb.org", "houzz.", "thumbtack.", "homeadvisor.",
    "yellowpages.", "porch.com", "buildzoom.", "procore.", "homeguide.",
    "downtobid.", "planhub.", "craigslist.", "facebook.", "instagram.",
    "linkedin.", "indeed.", "ziprecruiter.",
)
CONTACT_PATHS = ("", "/contact", "/contact-us", "/contactus", "/about", "/about-us",
                 "/get-a-quote", "/estimate")

# ---- fixed values: permits and leads ------------------------------------------------
BUILDER_TRADES = ("general contractor", "builder", "homebuilder", "home builder")
TAKEN_TRADES = ("concrete", "paving", "flatwork", "cement", "masonry")
LEAD_LABELS = {
    "open": "Nobody named for the job yet",
    "builder": "Run by a builder, who usually brings their own crew",
    "taken": "A concrete firm is already named",
    "unknown": "Somebody is named, trade not known",
}
LEAD_PRIORITY = {"open": 0, "builder": 1, "unknown": 2, "taken": 3}
# city, state, layout, date column, extra filter column and value, days back, centre
PERMIT_SOURCES = (
    ("Austin", "TX", "austin", "issue_date", "permit_type_desc", "Driveway / Sidewalks",
     45, 30.2672, -97.7431),
    ("Cambridge", "MA", "cambridge", "applicant_submit_date", None, None,
     270, 42.3736, -71.1097),
    ("Baton Rouge", "LA", "baton_rouge", "issueddate", "permittype", "Driveway Permit (R)",
     90, 30.4515, -91.1871),
)
CATEGORY_HINTS = ("type", "category", "class", "desc", "work", "subtype")
CATEGORY_EXCLUDE = ("state", "city", "status", "date", "county")
CATEGORY_VALUE_TERMS = ("driveway", "sidewalk", "curb cut", "curb ramp", "curb & gutter")
CATEGORY_MIN_COUNT = 3

# ---- fixed values: dates and zones --------------------------------------------------
MONTHS = ("January|February|March|April|May|June|July|August|September|October|November|"
          "December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec")
ZONE_HOURS = {
    "UTC": 0, "GMT": 0, "EST": -5, "EDT": -4, "ET": -5, "CST": -6, "CDT": -5, "CT": -6,
    "MST": -7, "MDT": -6, "MT": -7, "PST": -8, "PDT": -7, "PT": -8, "AKST": -9,
    "AKDT": -8, "HST": -10, "HAST": -10,
}
LATEST_ZONE_HOURS = -10

# ---- fixed values: states -----------------------------------------------------------
STATE_NAMES = {
    "AL": "alabama", "AK": "alaska", "AZ": "arizona", "AR": "arkansas",
    "CA": "california", "CO": "colorado", "CT": "connecticut", "DE": "delaware",
    "DC": "district of columbia", "FL": "florida", "GA": "georgia", "HI": "hawaii",
    "ID": "idaho", "IL": "illinois", "IN": "indiana", "IA": "iowa", "KS": "kansas",
    "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland",
    "MA": "massachusetts", "MI": "michigan", "MN": "minnesota", "MS": "mississippi",
    "MO": "missouri", "MT": "montana", "NE": "nebraska", "NV": "nevada",
    "NH": "new hampshire", "NJ": "new jersey", "NM": "new mexico", "NY": "new york",
    "NC": "north carolina", "ND": "north dakota", "OH": "ohio", "OK": "oklahoma",
    "OR": "oregon", "PA": "pennsylvania", "RI": "rhode island", "SC": "south carolina",
    "SD": "south dakota", "TN": "tennessee", "TX": "texas", "UT": "utah",
    "VT": "vermont", "VA": "virginia", "WA": "washington", "WV": "west virginia",
    "WI": "wisconsin", "WY": "wyoming",
}
TERRITORY_NAMES = {
    "PR": "puerto rico", "VI": "virgin islands", "GU": "guam", "AS": "american samoa",
    "MP": "northern mariana islands",
}
TYPE_ORDER = {"City": 0, "County": 1, "Special district": 2, "School district": 3}

# ---- fixed values: limits -----------------------------------------------------------
EARTH_RADIUS_MI = 3958.8
MAX_FAIL = 5
SEARCH_TRIP = 8
COOLDOWN_SEC = 300
COOLDOWN_STATUSES = (401, 403, 429)
QUOTA_STATUSES = (401, 402, 403, 429, 432)
UNDATED_MAX_DAYS = 60
MAX_ANCHOR_TOWNS = 6
MAX_PAGES_PER_DOMAIN = 4
DIGEST_MAX = 20
NOTICES_PER_DAY = 10
RECIPIENTS_MAX = 200
LEAD_MARGIN_MI = 25.0
TRIAL_DAYS = 7
BONUS_DAYS_REFERRER = 30
BONUS_DAYS_REFERRED = 14
MISS_RETRY_HOURS = 24
REGISTRY_MIN_ROWS = 5000
MIN_ORG_MATCH = 8
MIN_TITLE_MATCH = 12
