"""Fixed values.

Word lists, lookup tables, patterns, limits and text formats whose exact
content decides the result of a query.  They are data, not logic: every list is
compiled into column expressions by the modules in ``quarry.functions``.
"""

# ---------------------------------------------------------------- fixed values
# File scanning
SKIP_DIRS = [
    ".git", ".svn", ".hg",
    "node_modules", "__pycache__", ".venv", "venv", "env",
    "build", "dist", "target", "out", ".next",
    ".idea", ".vscode",
    "Pods", "DerivedData", ".Trash",
    ".cache", ".npm", ".yarn",
]
LEGACY_SKIP_DIRS = [
    "node_modules", "__pycache__", ".git", ".svn", ".hg",
    "venv", ".venv", "env", ".env", "build", "dist",
    "target", ".idea", ".vscode", "Pods", "DerivedData",
]
SYSTEM_FILES = [".DS_Store", "Thumbs.db", "desktop.ini"]
SKIP_EXTENSIONS = [
    ".zip", ".tar", ".gz", ".rar", ".7z",
    ".dmg", ".iso", ".pkg",
    ".exe", ".dll", ".so", ".dylib",
    ".mp4", ".mov", ".avi", ".mkv",
    ".mp3", ".wav", ".flac",
    ".lock", ".lockb",
]
TEXT_EXTENSIONS = [
    ".pdf", ".txt", ".md", ".docx", ".doc", ".rtf",
    ".py", ".js", ".ts", ".tsx", ".jsx", ".json",
    ".html", ".css", ".scss", ".yaml", ".yml",
    ".sh", ".bash", ".zsh", ".sql", ".r", ".swift",
    ".java", ".c", ".cpp", ".h", ".hpp", ".go", ".rs",
]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".gif", ".webp", ".bmp", ".tiff"]
PREVIEW_EXTENSIONS = [
    ".txt", ".md", ".json", ".js", ".ts", ".py", ".html", ".css", ".csv", ".xml", ".yaml", ".yml",
]
TYPE_DESCRIPTIONS = {
    ".pdf": "PDF document",
    ".txt": "text",
    ".md": "markdown",
    ".docx": "Word document",
    ".doc": "Word document",
    ".py": "Python code",
    ".js": "JavaScript code",
    ".ts": "TypeScript code",
    ".json": "JSON data",
    ".html": "HTML",
    ".css": "CSS stylesheet",
}

# Sizes and limits
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 200
LEGACY_CHUNK_SIZE, LEGACY_CHUNK_OVERLAP = 512, 128
FIRST_LINE_CHARS = 200
PREVIEW_CHARS = 4000
TITLE_CHARS = 150
DEBOUNCE_MS = 2000
MIN_DISK_BYTES = 100 * 1024 * 1024
ESCAPED_CONTEXT_CHARS = 500

# Query routing word lists
SYSTEM_WORDS = [
    "slow", "fast", "lag", "lagging", "freeze", "freezing", "hang", "hanging",
    "stuck", "crash", "crashing", "performance",
    "ram", "memory", "cpu", "processor", "storage", "disk", "space",
    "battery", "fan", "fans", "spinning", "loud", "noise", "noisy",
    "temperature", "hot", "heating", "overheating", "gpu", "graphics",
    "specs", "spec", "hardware", "system", "computer", "machine",
    "process", "processes", "running", "using", "usage",
    "can i run", "enough", "requirements", "capable",
]
WEB_WORDS = [
    "weather", "temperature outside", "forecast", "rain",
    "news", "latest", "current", "today's",
    "stock", "price of", "market", "bitcoin", "crypto",
    "who is", "what is", "when was", "where is",
    "time in", "timezone",
    "update available", "new version", "latest version",
    "when does", "when is", "start date", "release date",
    "how do i", "how to", "fix", "tutorial", "guide",
    "best", "recommend", "alternatives", "top 10", "vs",
]
FILE_WORDS = [
    "find", "search", "locate", "where", "open", "show me", "look for", "do i have",
    "get", "pull up", "bring up", "load", "access",
    "file", "document", "pdf", "photo", "picture", "image", "video", "spreadsheet",
    "presentation", "script", "code", "note", "notes",
    "folder", "directory", "project", "download", "saved",
    "my", "recent", "last", "latest", "yesterday", "today", "week",
    ".pdf", ".doc", ".txt", ".json", ".py", ".js", ".csv", ".xls",
    "resume", "contract", "report", "tax", "invoice", "receipt",
]
CASUAL_WORDS = [
    "hello", "hi", "hey", "thanks", "thank you", "bye", "goodbye",
    "how are you", "what's up", "good morning", "good night",
    "help", "what can you do", "who are you", "your name",
    "just saying", "nevermind", "never mind", "don't worry",
]
CASUAL_FILE_SUFFIXES = [".txt", ".pdf", ".doc", ".py", ".js"]
MEMORY_WORDS = [
    "about me", "do you know me", "what do you know about me",
    "my favorite", "my preference", "i like", "i prefer",
    "remember when", "last time", "you told me", "i told you",
    "my name", "my job", "my work", "my hobby", "my interest",
]
SEE_WORDS = [
    "see", "look at", "what's on", "screen", "screenshot",
    "what do you see", "describe what", "what am i looking at",
    "what is this", "analyze this", "what's happening",
    "show me what", "look at my", "can you see",
]
MULTI_PATTERNS = [
    "enough for", "can my computer run", "can i run", "will it run on my", "requirements",
    "compare my", "compare specs",
    "best model", "what model should i", "recommend a model", "which llm",
]
MULTI_TOOLS = ["local_query:system", "web_query"]
AMBIGUOUS_WORDS = [
    "is it", "should i", "can i", "will it", "enough",
    "better", "best", "recommend", "which one",
]
READ_WORDS = [
    "what does", "what's in", "what is in", "whats in",
    "say about", "says about", "contain", "contents of",
    "read", "show me what", "tell me what",
    "summarize", "summary of", "explain what",
    "describe what", "what are the", "list what",
    "details in", "information in", "data in",
]
OPEN_WORDS = ["open", "launch", "load", "pull up", "bring up", "start", "run"]
DISK_WORDS = [
    "what's taking space", "using space", "large files", "big files",
    "clean up", "cleanup", "free up space", "disk usage", "storage usage",
]
METRIC_WORDS = [
    (["cpu", "processes"], ["slow", "fast", "lag", "freeze", "performance", "cpu", "processor"]),
    (["memory"], ["ram", "memory"]),
    (["disk"], ["storage", "disk", "space"]),
    (["battery"], ["battery"]),
    (["gpu"], ["gpu", "graphics"]),
]
SECTION_WORDS = [
    ("memory", ["ram", "memory"]),
    ("cpu", ["cpu", "processor", "slow"]),
    ("disk", ["disk", "storage", "space"]),
    ("processes", ["process", "using", "running"]),
    ("battery", ["battery"]),
]
SEARCH_STOPWORDS = [
    "what", "where", "when", "who", "how", "why", "which", "whose",
    "does", "do", "did", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "can", "could", "will", "would", "should",
    "say", "says", "said", "tell", "show", "find", "get", "give",
    "contain", "contains", "include", "includes",
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "with", "about",
    "from", "by", "as", "into", "through",
    "my", "your", "his", "her", "its", "our", "their", "me", "you", "it",
    "please", "just", "also", "some", "any", "all", "this", "that", "these", "those",
]
PHOTO_STOPWORDS_CLIENT = [
    "the", "and", "for", "with", "from", "photo", "picture", "image", "find", "show", "open",
    "me", "my", "of", "in", "at", "on",
]
PHOTO_STOPWORDS_SERVER = [
    "the", "and", "for", "with", "from", "photo", "picture", "image", "find", "show", "open",
]
FALLBACK_LOCAL = r"\b(find|search|open|read|file|document|pdf|photo|image|folder|project|resume|tax)\b"
FALLBACK_SYSTEM = r"\b(ram|memory|cpu|disk|storage|battery|specs?|system|process|slow)\b"
FALLBACK_MEMORY = r"\b(my favorite|about me|remember|what do you know)\b"
FALLBACK_WEB = r"\b(weather|news|current|latest|stock|price|who is|what is today|search online)\b"
FALLBACK_NOT_WEB = r"\b(my|file|folder|document|downloaded)\b"
FALLBACK_CHAT = r"\b(hello|hi|hey|thanks|thank you|bye|help|what can you do)\b"
TOOL_ALIASES = {
    "local_query": "local_query",
    "web_query": "web_query",
    "conversation": "conversation",
    "multi_query": "multi_query",
    "see": "see",
    "search_files": "local_query",
    "read_file_content": "local_query",
    "open_file": "local_query",
    "get_system_info": "local_query",
    "analyze_disk": "local_query",
    "get_user_memory": "local_query",
    "web_search": "web_query",
    "mcp_search": "web_query",
    "no_tool": "conversation",
}
SMART_DEFAULT_TOOLS = ["search_files", "read_file_content", "open_file"]
FILE_TYPE_HINTS = [
    (["image"], ["photo", "picture", "image", "selfie", "screenshot"]),
    (["pdf", "document"], ["pdf", "document", "report", "resume", "contract"]),
    (["video"], ["video", "movie", "recording"]),
    (["audio"], ["music", "song", "audio", "podcast"]),
    (["code"], ["code", "script", "program", "python", "javascript"]),
    (["archive"], ["zip", "archive", "compressed"]),
]
LOCATION_HINTS = [
    ("downloads", ["download"]),
    ("documents", ["document"]),
    ("desktop", ["desktop"]),
    ("photos", ["photo", "picture", "image"]),
    ("projects", ["project", "code", "repo"]),
]
DATE_RANGE_HINTS = [
    ("today", ["today", "just now", "this morning"]),
    ("week", ["this week", "recent", "lately", "yesterday"]),
    ("month", ["this month", "last month"]),
    ("year", ["this year", "last year"]),
]

# Error policies: first matching error type, then action, level and message
ERROR_POLICIES = [
    ("PermissionError", "SKIP", "WARNING", "Permission denied: {file}"),
    ("FileNotFoundError", "SKIP", "DEBUG", "File not found (possibly deleted): {file}"),
    ("UnicodeDecodeError", "SKIP", "DEBUG", "Cannot decode file (binary?): {file}"),
    ("IsADirectoryError", "SKIP", "DEBUG", "Expected file, got directory: {file}"),
    ("OSError", "SKIP", "WARNING", "OS error reading file: {file} - {error}"),
]
DEFAULT_ERROR_POLICY = ("SKIP", "ERROR", "Unexpected error: {file} - {error}")

# Search scoring
PHOTO_SCORES = {
    "keyword": 2, "keyword_part": 1, "person": 3, "person_part": 2, "location": 1, "album": 1,
}
HYBRID_MIN_KEYWORD_HITS = 3
HYBRID_WEIGHTS = {"filename": 0.35, "content": 0.40, "keyword": 0.25}
HYBRID_MIN_SCORE = 0.35
CLUSTER_L1_FANOUT, CLUSTER_FANOUT = 10, 15
CLUSTER_MIN_LEAF, CLUSTER_MAX_LEAF, CLUSTER_MAX_DEPTH = 10, 50, 4

# Training example formats
CHUNK_FORMATS = [
    "[{idx}] {source}: {content}",
    "**{source}**: {content}",
    "{source} - {content}",
    "({idx}) {content}",
    "{content}",
]
PROMPT_FORMATS = [
    "Context:\n{chunks}\n\nQuestion: {question}",
    "## Context\n{chunks}\n\n## Question\n{question}",
    "Information: {chunks}\n\nQuery: {question}",
    "• {bullet}\n\nQuestion: {question}",
    "DATA:\n{kv}\n\nQUESTION: {question}",
    '{"context": "{escaped}", "question": "{question}"}',
    "Here's what I found: {chunks}\n\nYou asked: {question}",
    "{messy}\n---\n{question}",
]
REFUSAL = "Not found in provided context."
REFUSAL_MARK = "not found"
LAYER_SIZES = {1: 15000, 2: 15000, 3: 10000, 4: 10000, 5: 5000}
DIFFICULTY_SHARES = {"easy": 0.25, "medium": 0.35, "hard": 0.40}
NEGATIVE_SHARE = 0.10
DIFFICULTY_CHARS = {"easy": 300, "medium": 500, "hard": 500, "distractor": 200, "negative": 400}
POSITIVE_SHARE, REFUSAL_SHARE = 0.75, 0.25
MIN_REWRITE_CHARS = 5
REFUSAL_FAMILY_SHARES = [("wrong_domain", 0.40), ("out_of_scope", 0.35), ("partial_match", 0.25)]
PHASES = [
    # phase, name, part of the written set, description
    (1, "EXTRACTION", "layer=1", "Basic Extraction"),
    (2, "REASONING & FORMAT", "layer=2", "Logic + complex formats"),
    (3, "CONVERSATIONAL", "polarity=positive", "Natural responses"),
    (4, "REFUSALS", "layer=5", "Polite refusals"),
]

# Pools of the domain layer
SYSTEM_SPECS = [
    # cpu, cores, ram_total, ram_free, disk, disk_free
    ("Apple M2", 8, "8GB", "2GB", "256GB SSD", "48GB"),
    ("Apple M3 Pro", 12, "18GB", "6GB", "512GB SSD", "200GB"),
    ("Intel i7-12700", 12, "32GB", "12GB", "1TB SSD", "400GB"),
    ("AMD Ryzen 9 5900X", 12, "64GB", "32GB", "2TB NVMe", "1.2TB"),
    ("Apple M1", 8, "8GB", "1GB", "256GB SSD", "20GB"),
]
PEOPLE = [
    # job, company, language, city, interests
    ("software engineer", "tech startup", "Python", "Montreal", "AI/ML, gaming, music"),
    ("data scientist", "finance firm", "R", "Toronto", "statistics, hiking, cooking"),
    ("frontend developer", "agency", "TypeScript", "Vancouver", "UI design, photography, travel"),
]
SAMPLE_FILES = [
    # name, content, questions and answers
    ("resume.pdf",
     "Senior Software Engineer with 5 years of experience. Led implementation of real-time search system using "
     "Elasticsearch. Expert in Python, JavaScript, TypeScript, and Go. Built ML pipelines for NLP tasks.",
     [("What does my resume say about my experience?",
       "5 years of experience, led real-time search system, expert in Python, JavaScript, TypeScript, Go"),
      ("What programming languages do I know?", "Python, JavaScript, TypeScript, Go"),
      ("What's my job experience?", "Senior Software Engineer, 5 years, Elasticsearch, ML pipelines")]),
    ("project_notes.md",
     "Project Alpha: Using FastAPI for backend, React for frontend. Timeline: 3 months. Team: 4 developers. "
     "Status: In development, 60% complete.",
     [("What's Project Alpha using?", "FastAPI for backend, React for frontend"),
      ("How far along is the project?", "60% complete"),
      ("What's my current project status?", "In development, 60% complete")]),
    ("todo.txt",
     "1. Fix auth bug (HIGH priority, due tomorrow). 2. Update docs (LOW). 3. Review PR from Sarah (MEDIUM, due "
     "today). 4. Deploy to staging.",
     [("What should I work on first?", "Review PR from Sarah (due today) then fix auth bug (due tomorrow)"),
      ("What are my high priority tasks?", "Fix auth bug"),
      ("What's due today?", "Review PR from Sarah")]),
    ("meeting_notes.md",
     "Meeting with client on Tuesday 2pm. Discuss Q1 roadmap, budget increase request, and hiring timeline. "
     "Location: Zoom call.",
     [("When is my next meeting?", "Tuesday 2pm"),
      ("What's the meeting about?", "Q1 roadmap, budget increase, hiring timeline")]),
    ("config.py",
     "DATABASE_URL = 'postgresql://localhost:5432/myapp'. DEBUG = True. MAX_CONNECTIONS = 100. CACHE_TTL = 3600.",
     [("What's in this file?", "DATABASE_URL = 'postgresql://localhost:5432/myapp'")]),
]
GAME_REQUIREMENTS = [
    "Minimum: 8GB RAM, GTX 1060, 70GB storage. Recommended: 16GB RAM, RTX 2060, SSD for faster loading.",
    "Minimum: 16GB RAM, RTX 2060, 70GB storage. Recommended: 32GB RAM, RTX 3070.",
]

# Sentences and questions of the domain layer; names in braces are filled from the pools above
SYSTEM_SENTENCES = [
    "CPU: {cpu}, {cores} cores. RAM: {ram} total, {ram_free} free. Disk: {disk}, {disk_free} free.",
    "System specs - {cpu} ({cores}c), Memory: {ram} ({ram_free} available), Storage: {disk}",
    "cpu={cpu}\ncores={cores}\nram={ram}\nram_free={ram_free}\ndisk={disk_free} free",
]
SYSTEM_LINE = "CPU: {cpu}, RAM: {ram}"
MACHINE_LINE = "RAM: {ram}. GPU: {cpu}. Free disk: {disk_free}."
SYSTEM_QUESTIONS = [
    ("How much RAM do I have?", "{ram}"), ("How many CPU cores?", "{cores}"), ("What CPU do I have?", "{cpu}"),
    ("How much free disk space?", "{disk_free}"), ("How much free RAM?", "{ram_free}"),
]
SLOW_QUESTION = ("Why is my computer slow?", "Only {ram_free} RAM free")
PERSON_SENTENCE = (
    "Works as a {job} at {company}. Favorite programming language is {language}. Lives in {city}. Interested in {interests}."
)
PERSON_LINE = "Favorite language: {language}. Lives in {city}."
MEMORY_QUESTIONS = [
    ("What's my favorite programming language?", "{language}"), ("Where do I live?", "{city}"), ("What's my job?", "{job}"),
    ("Where do I work?", "{company}"), ("What are my interests?", "{interests}"),
]
MIXED_QUESTIONS = ["What's my favorite language?", "How much RAM do I have?", "What programming languages am I good at?"]
GAME_QUESTION = "Can I run this game?"
GAME_YES, GAME_NO = "Yes, meets minimum RAM requirement", "No, need 16GB RAM but only have {ram}"

# Pools of the refusal layer
REFUSAL_SYSTEM_CONTEXTS = [
    "CPU: Apple M2, 8 cores. RAM: 8GB total, 2GB free. Disk: 256GB SSD.",
    "Running processes: Chrome, Slack, VS Code, Docker. CPU usage: 45%.",
    "Network: Connected to WiFi. Download: 50 Mbps. Upload: 10 Mbps.",
]
REFUSAL_MEMORY_CONTEXTS = [
    "Works as a software engineer. Lives in Montreal. Interested in AI.",
    "Prefers dark mode. Uses VS Code. Favorite language is Python.",
    "Last project was a web scraper. Currently learning Rust.",
]
REFUSAL_FILE_CONTEXTS = [
    "Project timeline: Q1 planning, Q2 development, Q3 testing, Q4 launch.",
    "Meeting notes from Tuesday: Discussed roadmap, assigned tasks to team.",
    "Budget report: Marketing $50K, Engineering $200K, Operations $30K.",
]
REFUSAL_WEB_CONTEXTS = [
    "Weather in Montreal: 15°C, partly cloudy. Humidity: 65%.",
    "Python 3.12 features: Improved error messages, faster execution.",
    "Stock market today: S&P 500 up 0.5%, NASDAQ up 0.8%.",
]
WRONG_DOMAIN_QUESTIONS = [
    # pool, source, question
    ("system", "system", "What does my resume say about my skills?"),
    ("system", "system", "What's in my todo list?"),
    ("memory", "memory", "How much disk space do I have?"),
    ("memory", "memory", "What files are in my Documents folder?"),
    ("file", "notes.md", "What's the current weather?"),
    ("file", "report.pdf", "What time is my meeting?"),
    ("web", "web", "What's my favorite programming language?"),
]
OUT_OF_SCOPE_QUESTIONS = [
    "What will the weather be next week?",
    "Should I buy this stock?",
    "Is Python better than JavaScript?",
    "Will AI take over my job?",
    "What will my salary be next year?",
    "Is this a good investment?",
    "How will the project turn out?",
    "What's the meaning of life?",
]
OUT_OF_SCOPE_SOURCES = ["document", "system", "memory"]
PARTIAL_MATCHES = [
    # content, source, question
    ("Meeting on Tuesday with Sarah and Mike. Topics: roadmap, budget.", "notes.md", "Where is the meeting located?"),
    ("Project Alpha: 60% complete. Team of 4 developers.", "project.md", "When is the project due?"),
    ("Email: john@example.com. Lives in Montreal.", "contacts.txt", "What's my phone number?"),
    ("Weather in Montreal: 15°C, sunny.", "web", "What's the weather in Toronto?"),
    ("Files found: resume.pdf, notes.md, config.py", "search", "Show me my tax documents"),
]

# Pools of the synthetic set
SYNTHETIC_ENTITIES = ["John", "Sarah", "The server", "Project X", "The API"]
SYNTHETIC_ACTIONS = ["works at", "failed with", "deployed to", "started at", "connected to"]
SYNTHETIC_OBJECTS = ["Google", "Error 500", "production", "10:00 AM", "database"]
SYNTHETIC_NOISE = [
    "This is a random text about cooking pasta.",
    "The weather today is sunny with a chance of rain.",
    "Python is a programming language created by Guido van Rossum.",
    "The quick brown fox jumps over the lazy dog.",
]
