"""Fixed values.

Word lists, patterns, selectors, the prompt and the defaults below decide what
the results are, so they are stated as plain text in one place.  Every one of
them is only the default of a parameter.
"""

# Job keywords, tried in any order, case ignored.
JOB_KEYWORDS = (
    "hiring",
    "opening",
    "opportunity",
    "position",
    "job",
    "career",
    "vacancy",
    "recruitment",
    "apply",
    "experience required",
    "skills required",
    "role",
    "responsibilities",
    "qualifications",
    "immediate joining",
    "urgent hiring",
    "job description",
)

# Indicators of a job post; two of the seven must hold.  The words and patterns
# are searched for, so a plural "s" or a further digit in front changes nothing.
REQUIREMENT_WORDS = ("requirement", "qualification")
EXPERIENCE_WORD = "year"
EXPERIENCE_PATTERNS = (r"\d\+?\s*year", r"years? of experience")
ACTION_WORDS = ("apply", "send", "email", "dm", "interested", "opportunity")
RESUME_WORD = "resume"
CV_WORD = "cv"
POSITION_WORD = "position"
ROLE_WORD = "role"
MIN_INDICATORS = 2

# City names for the optional place filter.
CITY_TERMS = (
    "mumbai",
    "delhi",
    "bangalore",
    "hyderabad",
    "chennai",
    "kolkata",
    "pune",
    "ahmedabad",
    "noida",
    "gurgaon",
    "bengaluru",
)

# Where a post sits in a page, and where its parts sit in the post.
POST_CONTAINERS = (
    "div.feed-shared-update-v2",
    "div.update-components-actor",
    "div[data-urn^='urn:li:activity']",
)
POST_CONTENT = "span.break-words"
POST_ACTOR_TITLE = "span.update-components-actor__title"
POST_ID_ATTRIBUTE = "data-urn"
POST_BASE_URL = "https://www.linkedin.com/feed/update/"

# Columns of the plain CSV, in file order.
CORE_COLUMNS = ("content", "url", "profile_name")

# Defaults of the run.
SEARCH_TEXT = "Data Scientist"
MAX_PAGES = 20
MAX_POSTS = 10
MODEL_NAME = "deepseek-r1:1.5b"

# System prompt of the hiring label.
HIRING_PROMPT = (
    "You will be given the content of a LinkedIn post. Analyze the post and determine if it is related to hiring, job postings, or recruitment activities. "
    "A hiring post generally refers to announcements or advertisements about job openings, available positions, recruitment drives, or opportunities that seek candidates. "
    "\n\n"
    "Instructions:\n"
    "1. Carefully review the LinkedIn post provided.\n"
    "2. Decide if it can be considered a hiring/recruitment-related post based on keywords, intent, and context.\n"
    "3. Output your result strictly in the following JSON format:\n"
    "{\n"
    '  "classification": 1 or 0\n'
    "}\n"
    "\nRules:\n"
    '- Respond with "classification": 1 if the post is a hiring/recruitment post.\n'
    '- Respond with "classification": 0 if the post is not related to hiring or recruitment.\n'
    "- Do NOT include any explanation, extra text, or context; only reply with the JSON as shown above.\n"
)
