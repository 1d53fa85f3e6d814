"""Word lists, weights and thresholds the results depend on. Order matters wherever rules are tried in turn."""

# ---- lead score -----------------------------------------------------------------------------------------------
SCORE_WEIGHTS = {
    "email_available": 25, "phone_available": 15, "linkedin_profile": 20, "senior_title": 35, "company_size": 15,
    "industry_match": 20, "location_match": 10, "domain_quality": 15, "name_completeness": 10, "email_quality": 10,
    "data_freshness": 5, "social_presence": 8, "company_maturity": 12, "lead_source_quality": 8,
}
EXECUTIVE_TITLES = [
    "ceo", "cto", "cfo", "president", "founder", "chief executive", "chief technology", "chief financial",
    "chief marketing", "chief operating", "chief product", "chief data", "chief innovation", "chief revenue",
    "managing partner", "executive chairman", "board member",
]
SENIOR_TITLES = [
    "vp", "vice president", "director", "head of", "senior director", "executive director", "managing director",
    "general manager", "senior vice president", "svp", "principal", "senior principal",
]
MANAGER_TITLES = [
    "manager", "senior manager", "lead", "principal", "team lead", "project manager", "product manager",
    "program manager", "engineering manager", "marketing manager", "sales manager", "operations manager",
    "development manager",
]
INDUSTRY_TIERS = {
    "tier_1": ["artificial intelligence", "machine learning", "ai", "ml", "saas", "fintech", "cybersecurity", "blockchain",
               "cryptocurrency", "quantum computing", "robotics", "autonomous vehicles", "space technology"],
    "tier_2": ["technology", "software", "cloud computing", "data science", "biotechnology", "medtech", "healthtech",
               "edtech", "proptech", "clean energy", "renewable energy", "electric vehicles"],
    "tier_3": ["e-commerce", "digital marketing", "consulting", "finance", "healthcare", "telecommunications",
               "automotive", "manufacturing", "logistics", "supply chain", "agriculture tech"],
}
DOMAIN_TIERS = {
    "tier_1": [".ai", ".io", ".tech", ".dev", ".app"],
    "tier_2": [".com", ".co", ".inc"],
    "tier_3": [".net", ".org", ".biz", ".info"],
}
LOCATION_TIERS = {
    "tier_1": ["san francisco", "palo alto", "mountain view", "cupertino", "seattle", "new york", "boston", "austin",
               "los angeles", "london", "berlin", "tel aviv", "singapore", "shenzhen", "bangalore", "toronto", "vancouver"],
    "tier_2": ["chicago", "denver", "atlanta", "dallas", "miami", "amsterdam", "paris", "munich", "zurich", "stockholm",
               "copenhagen", "sydney", "melbourne", "tokyo", "seoul", "hong kong", "dublin", "barcelona", "milan"],
    "tier_3": ["phoenix", "philadelphia", "washington dc", "portland", "edinburgh", "manchester", "warsaw", "prague",
               "vienna", "helsinki", "oslo", "lisbon", "madrid", "rome"],
}
ENGLISH_COUNTRIES = ["usa", "canada", "uk", "australia", "new zealand"]
EU_COUNTRIES = ["germany", "france", "netherlands", "sweden", "denmark"]
PROFESSIONAL_MAILBOX = r"^([a-z]+\.[a-z]+@|[a-z]+[a-z]+@|[a-z]\.[a-z]+@|[a-z]+\.[a-z]@)"
GENERIC_MAILBOXES = ["info@", "contact@", "hello@", "support@", "admin@", "sales@", "marketing@", "hr@", "jobs@", "team@"]
HARSH_MAILBOXES = ["info@", "contact@"]
SCORE_FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "protonmail.com",
                      "mail.com", "yandex.com", "qq.com", "163.com"]
SIZE_MULTIPLIERS = {"1-10": 0.4, "11-50": 0.6, "51-200": 0.8, "201-500": 1.0, "501-1000": 1.2, "1000+": 1.4, "5000+": 1.6, "10000+": 1.8}
SOURCE_MULTIPLIERS = {"linkedin": 1.3, "hunter": 1.2, "website": 1.1, "referral": 1.4, "event": 1.2, "webinar": 1.1,
                      "directory": 1.0, "google": 0.9, "manual": 1.0, "import": 0.8, "purchased": 0.6}
SOURCE_EXTRA = {"referral": 5, "event": 3, "webinar": 3, "organic": 4}
VALUED_FUNCTIONS = ["engineering", "product", "data", "ai", "ml", "software", "technical", "revenue", "growth",
                    "business development", "strategy", "innovation"]
PROFESSIONAL_TERMS = ["leading", "innovative", "established", "founded", "expertise"]
REVENUE_MARKS = ["million", "billion", "m+", "b+"]
FUNDING_MARKS = ["series a", "series b", "series c", "funded", "investment", "venture"]
STABLE_INDUSTRIES = ["banking", "insurance", "pharmaceuticals", "utilities"]
FAKE_NAME_WORDS = ["test", "example", "demo", "sample", "admin", "user"]
DECISION_WORDS = ["director", "manager", "head", "lead", "chief", "vp", "president", "owner", "founder", "partner", "executive"]
INDUSTRY_TRENDS = {"artificial intelligence": 15, "machine learning": 12, "generative ai": 18, "quantum computing": 20,
                   "cybersecurity": 10, "fintech": 12, "climate tech": 14, "space technology": 16}
ENTERPRISE_SIZES = ["1000+", "5000+", "10000+"]
ENTERPRISE_TITLES = ["chief", "vp", "vice president", "director", "head of"]
SMB_SIZES = ["1-10", "11-50", "51-200"]
INTENT_TITLES = ["ceo", "cto", "founder", "owner", "president", "vp"]
GROWTH_WORDS = ["growing", "expanding", "scaling", "hiring", "funding"]
SCORE_TIERS = [(90, "Exceptional"), (80, "Excellent"), (70, "High"), (55, "Medium"), (40, "Low")]

# ---- priority analysis ----------------------------------------------------------------------------------------
PRIORITY_WEIGHTS = {"contact": 0.25, "company": 0.35, "role": 0.25, "timing": 0.15}
LEVELS = [(85, "critical"), (70, "high"), (50, "medium")]
ROLE_EXECUTIVE = ["ceo", "cto", "cfo", "founder", "president", "owner"]
HIGH_VALUE_INDUSTRIES = ["technology", "software", "saas", "fintech", "healthcare", "consulting"]
OPTIMAL_SIZES = ["51-200", "201-500", "101-250", "251-500"]
INTENT_SOURCES = ["demo_request", "pricing_inquiry", "contact_form"]

# ---- analyzer features ----------------------------------------------------------------------------------------
FEATURE_SENIORITY = [
    (95, ["ceo", "cto", "cfo", "president", "founder", "chief"]),
    (80, ["vp", "vice president", "director", "head of", "senior director"]),
    (65, ["manager", "lead", "principal", "senior manager"]),
    (50, ["senior", "principal"]),
]
FEATURE_DECISION = [
    (95, ["ceo", "president", "founder", "owner", "partner"]),
    (80, ["cto", "cfo", "vp", "vice president", "director"]),
    (60, ["head of", "manager", "lead"]),
    (40, ["senior", "principal", "specialist"]),
]
FEATURE_INDUSTRY = [
    (95, ["ai", "artificial intelligence", "machine learning", "saas", "fintech", "cybersecurity"]),
    (80, ["technology", "software", "cloud", "data", "biotech", "healthtech"]),
    (65, ["finance", "healthcare", "consulting", "e-commerce"]),
]
FEATURE_SIZE = [
    (90, ["201-500", "501-1000"]), (85, ["51-200"]), (80, ["1001-5000"]), (70, ["11-50"]), (60, ["1-10"]), (60, ["5000+"]),
]
FEATURE_LOCATION = [
    (90, ["san francisco", "silicon valley", "new york", "seattle", "boston", "austin", "london", "tel aviv"]),
    (75, ["chicago", "denver", "atlanta", "toronto", "vancouver", "berlin", "amsterdam", "singapore"]),
    (65, ["usa", "canada", "uk", "australia", "new zealand"]),
]
FEATURE_SOURCE = {"linkedin": 90, "referral": 95, "website": 80, "event": 85, "webinar": 75, "hunter": 70, "directory": 65,
                  "google": 60, "manual": 70, "import": 50, "purchased": 30}
FEATURE_FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com"]
FEATURE_GENERIC = ["info", "contact", "admin", "support", "sales"]
TIMEZONES = [
    ("America/Los_Angeles", ["san francisco", "seattle", "los angeles"]),
    ("America/New_York", ["new york", "boston", "atlanta"]),
    ("America/Chicago", ["chicago", "austin", "denver"]),
    ("Europe/London", ["london", "uk"]),
    ("Europe/Berlin", ["berlin", "germany"]),
    ("Asia/Singapore", ["singapore"]),
    ("Australia/Sydney", ["sydney"]),
]
OUTCOME_SCORES = {"converted": 95, "qualified": 85, "interested": 75, "responded": 65, "contacted": 55, "no_response": 40,
                  "rejected": 20, "unqualified": 15}

# ---- data quality ---------------------------------------------------------------------------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
LINKEDIN_PATTERN = r"^https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]+/?$"
WEBSITE_PATTERN = r"^https?://(?:[-\w.])+(?:\.[a-zA-Z]{2,})+(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?$"
SUSPICIOUS_EMAILS = [r"test@test\.com", r"example@example\.com", r"admin@admin\.com", r"noreply@", r"donotreply@", r"^\d+@",
                     r"test\d+", r"^(a+|b+|c+)@"]
INDUSTRY_MAP = {
    "tech": ["technology", "software", "it", "computer", "digital"],
    "finance": ["financial", "banking", "investment", "insurance"],
    "healthcare": ["health", "medical", "pharmaceutical", "biotech"],
    "education": ["educational", "university", "school", "academic"],
    "retail": ["ecommerce", "e-commerce", "shopping", "consumer"],
}
SIZE_MAP = {
    "1-10": ["1-10", "startup", "micro", "very small"],
    "11-50": ["11-50", "small", "11-49", "10-50"],
    "51-200": ["51-200", "medium", "50-200", "51-199"],
    "201-500": ["201-500", "medium-large", "200-500"],
    "501-1000": ["501-1000", "large", "500-1000"],
    "1001-5000": ["1001-5000", "large", "1000-5000"],
    "5000+": ["5000+", "enterprise", "very large", "5001+"],
}
QUALITY_WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "email": 0.15, "phone": 0.10, "freshness": 0.05}
QUALITY_FREE_DOMAINS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com"]
QUALITY_GENERIC = ["info", "contact", "admin", "support", "sales", "hello", "team"]
US_PHONE = r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$"
INTERNATIONAL_PHONE = r"^\+[1-9][0-9]{1,14}$"
FAKE_PHONE = r"^([0-9])\1{9,}|^123456|^000000|^111111"
FAKE_TITLE = r"^test\s+|^fake\s+|^sample\s+|^[0-9]+$|^[^a-zA-Z]*$"
ROLE_MAILBOXES = ["admin", "administrator", "info", "contact", "support", "help", "sales", "marketing", "hr", "noreply",
                  "no-reply", "postmaster"]
DISPOSABLE_DOMAINS = ["10minutemail.com", "tempmail.org", "guerrillamail.com", "mailinator.com", "throwaway.email", "temp-mail.org"]
COUNTRY_CODES = {"+1": "US/Canada", "+44": "United Kingdom", "+49": "Germany", "+33": "France", "+86": "China",
                 "+91": "India", "+81": "Japan", "+82": "South Korea"}
TITLE_ABBREVIATIONS = ["CEO", "CTO", "CFO", "CMO", "VP", "SVP", "EVP", "COO", "IT", "HR", "QA"]
PAIR_WEIGHTS = {"email": 0.4, "name": 0.25, "phone": 0.15, "linkedin": 0.1, "company": 0.07, "title": 0.03}
