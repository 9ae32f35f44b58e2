"""Fixed values that must equal the behaviour being rebuilt.

FIXED VALUES — stated plainly, in their natural order:

* safety defaults: allowed directories ``CodeSandBox``; blocked path patterns
  (unanchored regexes) ``node_modules``, ``\\.git``, ``dist``, ``build``;
  blocked command tokens ``rm -rf``, ``sudo``, ``shutdown``, ``reboot``,
  ``kill``, ``passwd``, ``format``; read-only file names ``package.json``,
  ``package-lock.json``; prohibited extensions ``.exe``, ``.sh``, ``.bat``,
  ``.cmd``.
* names hidden from directory listings: ``node_modules``, ``dist``,
  ``build``, ``.git``.
* run-state defaults: current step ``reception``, strategy ``PENDING``,
  deployment status ``PENDING``, retry count 0, workspace ``""``.
* retry limit 3; approval time-out 300 s; poll interval 30 s; search cap 50;
  web results 3; binary probe 4,000 bytes; truncation 500 characters.
* workflow edges: START→architect; architect→data-ops, pipeline-coder, END;
  pipeline-coder→deployer; deployer→pipeline-coder, data-ops, END;
  data-ops→END.
"""

ALLOWED_PATHS = ["CodeSandBox"]
BLOCKED_PATTERNS = ["node_modules", "\\.git", "dist", "build"]
BLOCKED_COMMANDS = ["rm -rf", "sudo", "shutdown", "reboot", "kill", "passwd", "format"]
READ_ONLY_FILES = ["package.json", "package-lock.json"]
NOT_ALLOWED_EXTENSIONS = [".exe", ".sh", ".bat", ".cmd"]
IGNORED_NAMES = ["node_modules", "dist", "build", ".git"]

DEFAULT_STEP = "reception"
DEFAULT_STRATEGY = "PENDING"
DEFAULT_STATUS = "PENDING"
DEFAULT_WORKSPACE = ""
DEFAULT_DIAGRAM = '{"nodes":[],"edges":[]}'

MAX_RETRIES = 3
ACK_TIMEOUT_SECONDS = 300
POLL_SECONDS = 30
SEARCH_CAP = 50
WEB_RESULTS = 3
BINARY_PROBE_BYTES = 4000
TRUNCATE_AT = 500

START = "__start__"
END = "__end__"
WORKFLOW_EDGES = [
    (START, "architect"),
    ("architect", "data-ops"),
    ("architect", "pipeline-coder"),
    ("architect", END),
    ("pipeline-coder", "deployer"),
    ("deployer", "pipeline-coder"),
    ("deployer", "data-ops"),
    ("deployer", END),
    ("data-ops", END),
]

# FIXED VALUES: texts that appear in results.
EMPTY_FILE_MARKER = "[File is empty]"
NO_DISCOVERY_TEXT = "No infrastructure discovered."
NO_SUMMARY_TEXT = ("I have successfully analyzed your request and formulated a "
                   "cloud architecture plan.")
EXECUTED_TASK_TEXT = "Executed Task."
TOOL_OUTPUT_PREFIX = "[Discovery Tool Output]: "
FAILED_PREFIX = "Command failed:"

# JavaScript's String.prototype.trim strips these code points (ECMAScript
# WhiteSpace and LineTerminator); Spark's trim strips only spaces.
JS_WS_CODEPOINTS = ([0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680]
                    + list(range(0x2000, 0x200B))
                    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
JS_WS_CHARS = "".join(chr(c) for c in JS_WS_CODEPOINTS)
