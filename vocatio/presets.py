"""Rule tables, word lists and weights that decide results.

Every value here is fixed by the behaviour the engine has to reproduce.
"""

from __future__ import annotations

# --- fixed values: source column -> unified column, per posting source -----------------------
UNIFIED_POSTING_COLUMNS = [
    "id", "source", "job_link", "job_title", "company", "job_location", "job_level", "job_type", "description",
]
SOURCE_COLUMNS = {
    "linkedin": {
        "job_title": "job_title",
        "company": "company",
        "job_location": "job_location",
        "job_level": "job_level",
        "job_type": "job_type",
        "job_link": "job_link",
    },
    "indeed": {
        "job_title": "job_title",
        "company": "company",
        "job_location": "location",
        "description": "summary",
    },
    "glassdoor": {
        "job_title": "position",
        "company": "company",
        "job_location": "location",
        "description": "Job Description",
    },
}

# --- fixed values: seniority by regular expression, first hit wins ----------------------------
SENIORITY_REGEX_RULES = [
    ("intern", r"(?i)\b(intern|internship)\b"),
    ("junior", r"(?i)\b(jr\.?|junior|entry|graduate|trainee)\b"),
    ("senior", r"(?i)\b(sr\.?|senior|ii|iii|iv)\b"),
    ("lead/principal", r"(?i)\b(principal|staff|head of|director|vp|chief|lead)\b"),
    ("junior", r"(?i)\bassociate\b"),
]
SENIORITY_DEFAULT = "mid"

# --- fixed values: seniority by substring, first hit wins -------------------------------------
SENIORITY_SUBSTRING_RULES = [
    ("intern", ["intern", "internship", "trainee"]),
    ("principal", ["principal", "staff", "distinguished"]),
    ("lead", ["lead", "head of", "director", "vp", "chief"]),
    ("senior", ["senior", "sr.", "sr "]),
    ("junior", ["junior", "jr.", "jr ", "entry"]),
]

# --- fixed values: level names of a CV ---------------------------------------------------------
LEVEL_SYNONYMS = [
    ("entry level", ["entry", "entry-level", "intern", "junior"]),
    ("mid-level", ["mid", "mid-senior"]),
    ("senior level", ["senior"]),
    ("expert level", ["expert", "principal"]),
]
LEVEL_BY_YEARS = [(2, "entry level"), (6, "mid-level"), (11, "senior level")]
LEVEL_ABOVE = "expert level"

# --- fixed values: placeholders and defaults ---------------------------------------------------
PLACEHOLDERS = ["", "Unknown", "Not Provided"]
COMPANY_PLACEHOLDERS = ["Fresher"]
DEFAULT_TITLE = "Professional"
DEFAULT_COMPANY = "various organizations"
DEFAULT_SKILLS = "various technical skills"

# --- fixed values: groups of technical skills in a CV document ---------------------------------
SKILL_GROUPS = [
    "programming_languages", "frameworks", "databases", "cloud", "tools", "web_technologies", "testing",
    "automation", "project_management", "networking_skills", "software", "software_tools", "operating_systems",
    "other",
]

# --- fixed values: level phrases in rendered texts ---------------------------------------------
LEVEL_PHRASES_SHORT = {
    "intern": "Internship level",
    "junior": "Junior level, 1-2 years experience",
    "mid": "Mid-level, 3-5 years experience",
    "senior": "Senior level, 5+ years experience",
    "lead/principal": "Principal level, 8+ years experience",
}
LEVEL_PHRASES_LONG = {
    "intern": "Intern level, entry position",
    "junior": "Junior level, 0-2 years experience",
    "mid": "Mid-level, 3-5 years experience",
    "senior": "Senior level, 5+ years experience",
    "lead": "Lead level, 7+ years experience with leadership",
    "principal": "Principal level, expert with technical leadership",
}
WORK_TYPE_PHRASES = {
    "remote": "Remote work available",
    "hybrid": "Hybrid work, partially remote",
    "onsite": "Onsite",
}
WORK_TYPE_PHRASES_POSTING = {
    "remote": "Remote work available",
    "hybrid": "Hybrid work, partially remote",
    "onsite": "Onsite work",
}

# --- fixed values: occupation major groups (ISCO-08), first hit wins ---------------------------
OCCUPATION_RULES = [
    (1, ["manager", "director", "chief", "head of", "president", "vp ", "vice president", "ceo", "cfo", "cto",
         "coo", "executive", "supervisor", "lead", "principal"]),
    (2, ["engineer", "developer", "scientist", "doctor", "nurse", "teacher", "professor", "architect", "designer",
         "analyst", "consultant", "specialist", "attorney", "lawyer", "accountant", "pharmacist", "therapist",
         "physician"]),
    (3, ["technician", "associate", "assistant", "coordinator", "representative", "administrator", "officer",
         "agent", "inspector", "controller"]),
    (4, ["clerk", "secretary", "receptionist", "cashier", "teller", "bookkeeper", "data entry", "typist",
         "filing"]),
    (5, ["sales", "retail", "customer service", "waiter", "waitress", "bartender", "cook", "chef", "server",
         "barista", "store", "shop"]),
    (6, ["farmer", "agricultural", "fisherman", "forestry", "gardener", "rancher"]),
    (7, ["electrician", "mechanic", "plumber", "carpenter", "welder", "machinist", "installer", "repair",
         "maintenance", "hvac"]),
    (8, ["driver", "operator", "machine", "assembler", "production", "manufacturing", "warehouse", "forklift",
         "truck"]),
    (9, ["cleaner", "janitor", "helper", "laborer", "packer", "loader", "dishwasher", "housekeeper",
         "security guard"]),
    (0, ["military", "army", "navy", "marine", "air force", "soldier"]),
]
OCCUPATION_DEFAULT = 2
OCCUPATION_NAMES = {
    0: "Military",
    1: "Managers",
    2: "Professionals",
    3: "Technicians",
    4: "Clerical",
    5: "Service/Sales",
    6: "Agriculture",
    7: "Craft/Trade",
    8: "Operators",
    9: "Elementary",
}

# --- fixed values: words that are not skills ----------------------------------------------------
STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "shall", "can", "need", "our", "we", "you", "your", "they", "their", "its", "it", "that",
    "this", "which", "what", "who", "whom", "any", "all", "some", "more", "most", "other", "each", "few", "many",
    "such", "no", "not", "only", "same", "so", "than", "too", "very", "just", "also", "now",
]
GENERIC_WORDS = [
    "experience", "years", "strong", "team", "work", "working", "position", "ability", "able", "excellent", "good",
    "great", "skills", "knowledge", "understanding", "familiarity", "proficiency", "expertise", "demonstrated",
    "proven", "equivalent", "gain", "various", "different", "multiple", "new", "within", "across", "using",
    "including", "related", "required", "preferred", "minimum", "ideal", "desirable", "essential", "degree",
    "bachelor", "master", "diploma", "intern", "internship", "job", "role", "opportunity", "employment", "company",
    "organization", "business", "environment", "requirements", "responsibilities", "status", "seeking", "level",
    "current", "support",
]
GENERIC_SINGLE_WORDS = [
    "data", "information", "process", "systems", "solutions", "pull", "building", "tools", "supporting",
    "identification", "preparation", "methodology", "investigations", "engagement", "developer", "engineer",
    "analyst", "scientist", "manager", "coordinator", "director", "supervisor", "administrator", "assistant",
    "associate", "officer", "executive", "remote", "exposure", "issues", "structure", "structures", "oversight",
    "computer", "lead", "maintenance",
]
MIN_SKILL_LENGTH = 3
MIN_DICTIONARY_COUNT = 100
REFRESH_STOP_TERMS = ["experience", "years", "skills", "work", "team", "project"]

# --- fixed values: document type by keyword -----------------------------------------------------
CV_KEYWORDS = [
    "resume", "curriculum vitae", "work experience", "education", "skills:", "references", "objective",
    "career summary", "professional experience", "employment history", "qualifications",
]
JOB_KEYWORDS = [
    "job description", "responsibilities", "requirements:", "we are looking", "apply now", "salary range",
    "benefits:", "about the role", "about us", "position:", "how to apply", "equal opportunity", "must have",
    "nice to have",
]

# --- fixed values: patterns of candidate skill terms -------------------------------------------
CANDIDATE_TERM_PATTERNS = [
    r"\b([A-Z][a-z]+(?:\.[A-Za-z]+)?)\b",
    r"\b([A-Za-z]+(?:JS|SQL|ML|AI|DB|API))\b",
    r"\b([A-Za-z]+\s*\d+(?:\.\d+)?)\b",
    r"\b([A-Z]{2,6})\b",
]
CANDIDATE_SECTION_PATTERN = r"skills[:\s]+([^.]+)"
CANDIDATE_SECTION_SEPARATOR = r"[,;|]"

# --- fixed values: fields of a pasted posting ---------------------------------------------------
POSTING_TITLE_SKIP = r"^(company|location|salary|type)"
POSTING_COMPANY_PATTERN = r"(?i)company[:\s]+([^\n]+)"
POSTING_LOCATION_PATTERN = r"(?i)location[:\s]+([^\n]+)"
POSTING_SALARY_PATTERN = "\\$?([\\d,]+)\\s*[-–]\\s*\\$?([\\d,]+)"
POSTING_YEARS_PATTERN = r"(?i)(\d+)\+?\s*years?"
POSTING_FIELD_CHARS = 100

# --- fixed values: feedback -----------------------------------------------------------------------
EVENT_SIGNALS = {
    "candidate_apply": 0.5,
    "candidate_save": 0.3,
    "candidate_view": 0.1,
    "recruiter_shortlist": 0.4,
    "recruiter_interview": 0.7,
    "recruiter_hire": 1.0,
    "recruiter_reject": -0.3,
    "skip": -0.1,
}
SCORE_WEIGHTS = {"alpha": 1.0, "beta": 0.5, "gamma1": 0.1, "gamma2": 0.1, "delta": 0.0}
ACTION_WEIGHTS = {
    "apply": 1.0,
    "contact": 1.0,
    "hire": 1.0,
    "save": 0.5,
    "view_full": 0.3,
    "skip": 0.0,
    "not_interested": -0.5,
}
WEIGHT_GRID = {
    "alpha": [0.8, 1.0, 1.2],
    "beta": [0.3, 0.5, 0.7],
    "gamma1": [0.05, 0.1, 0.15],
    "gamma2": [0.05, 0.1, 0.15],
    "delta": [0.0, 0.1, 0.2, 0.3],
}
WEIGHT_LOW, WEIGHT_HIGH, WEIGHT_PENALTY = 0.05, 2.0, 0.1
RETRAIN_THRESHOLD = 50
MIN_POSITIVE_WEIGHT = 0.5
MIX_RATIO = 0.2
MIN_TRAINING_PAIRS = 10
MIN_PROPOSAL_FREQUENCY = 3
# Marks and line ends that a term of a refresh does not go beyond.
CLAUSE_END = r"[.,;:!?()\[\]{}|/\n\r\t\u2022]+"

# --- fixed values: retrieval, sampling, files ------------------------------------------------------
CANDIDATES = 50
RERANK_KEEP = 30
CVS_PER_JOB = 10
PAGE_SIZE = 10
RECALL_AT = [1, 5, 10, 50]
GREAT_ABOVE, GOOD_ABOVE = 5, 0
IVF_CELLS = 1500
IVF_ROUNDS, IVF_TOLERANCE = 20, 1e-4
IVF_PROBES = 20
SAMPLE_BUFFER = 1.1
SPLIT_FRACTIONS = (("train", 0.8), ("val", 0.1), ("test", 0.1))
MESSAGES_PER_FILE = 10_000
# Tables that are not written message by message: large files, so that a large table has few of them.
ROWS_PER_FILE = 1_000_000
EMBEDDINGS_PER_FILE = 50_000
QUERY_PREFIX, PASSAGE_PREFIX = "query: ", "passage: "
DOCUMENT_EXTENSIONS = [".txt", ".csv"]
# Supported formats that are no text; they need a parser of their own and go to the dead letters.
BINARY_EXTENSIONS = [".pdf", ".docx", ".doc"]
MIN_DOCUMENT_CHARS = 10
JOB_SKILLS_SHORT, JOB_SKILLS_LONG, CV_SKILLS = 10, 15, 15
