"""Values that must stay as they are for results and stored files to agree."""

# Time formats of run directories, schedule files, log lines and pages.
RUN_DIR_FORMAT = "MM-dd-yyyy.HH.mm.ss.SSS"
SCHEDULE_FORMAT = "yyyy-MM-dd.HH.mm.ss.SSS"
LOG_TIME_FORMAT = "dd-MM-yyyy HH:mm:ss"
PAGE_DATE_FORMAT = "MM-dd-yyyy"
PAGE_TIME_FORMAT = "MM-dd-yyyy HH:mm:ss"

# File names, suffixes and markers.
RUN_PROPERTIES_FILE = "run.properties"
JOB_SUFFIX = ".job"
CONFIG_SUFFIXES = (".properties", ".schema")
SKIPPED_NAMES = ("__MACOSX",)
LATEST_MARKER = "#LATEST"
DEPENDENCIES_KEY = "dependencies"
DEFAULT_FOLDER = "default"

# States of a job or a flow.
STATUSES = ("RUNNING", "SUCCEEDED", "FAILED", "READY", "COMPLETED", "IGNORED")

# Level names that may lead a child process's line.
LOG_LEVELS = ("DEBUG", "ERROR", "INFO", "WARN", "FATAL", "TRACE")

# Sizes and limits.
TAIL_LINES = 60
TAIL_BYTES = 200 * 1024
RING_LINES = 30
PREVIEW_ROWS = 1000
PREVIEW_CHARS = 1_000_000
HISTORY_PAGE_ROWS = 20
LATE_AFTER_SECONDS = 1

# Patterns.
VARIABLE_PATTERN = r"\$\{([a-zA-Z_.0-9]+)\}"
LIST_SEPARATOR = r"\s*,\s*"
LOG_LINE_PATTERN = r"^(\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}) (\S+) (\S+) - (.*)$"

# What counts as a separator in a word count.
WORD_SEPARATORS = r"[ \t\n\r\f]+"

# The wording of a failure report.
REPORT_JOB = " Job {number}. {job}:\n{error}\n"
REPORT_NO_RUN = "Job execution object is null for jobId:{job}\n\n"
REPORT_NO_LOG = "Log path is null. \n\n"
REPORT_LOG = "See log in {url}{log}\n\nThe last {lines} lines in the log are:\n"
