"""Values that must equal the published rules for results to agree.

Everything here is data. The logic that uses it lives in the sibling modules.
"""

# --- fault domain -----------------------------------------------------------
# fixed values
EQUIPMENT = {
    "COAX": ("Cisco cBR-8", "Arris E6000", "Casa C100G", "Harmonic CableOS"),
    "FIBER": ("Nokia 7750", "Juniper MX960", "Cisco ASR9000", "Huawei MA5800"),
}

# fixed values
LOCATIONS = (
    "Copenhagen Central", "Aarhus North", "Odense West", "Aalborg East", "Esbjerg South",
    "Roskilde", "Kolding", "Horsens", "Vejle", "Silkeborg",
)

# fixed values, per category: codes, descriptions, severity, customer impact,
# share of faults (%), resolution hours, customers, service calls, priority, and
# the percentage of faults that get an even chance of a first-time fix
CATEGORIES = {
    "Minor": {
        "codes": ("100.1", "200.2", "300.5", "400.1", "500.3"),
        "descriptions": (
            "Signal level deviation", "Minor packet loss detected", "Configuration drift",
            "Low bandwidth utilization", "Routine maintenance alert",
        ),
        "severity": "Low", "customer_impact": "Minimal", "share": 60,
        "hours": (0.5, 4.0), "customers": (1, 50), "calls": (0, 5), "priority": (0.1, 1.0),
        "fix_chance": 85,
    },
    "Major": {
        "codes": ("600.1", "700.2", "800.3", "900.1", "150.4"),
        "descriptions": (
            "Service degradation detected", "High error rate on interface",
            "Power supply fluctuation", "Temperature threshold exceeded",
            "Multiple customer complaints",
        ),
        "severity": "Medium", "customer_impact": "Moderate", "share": 30,
        "hours": (2.0, 12.0), "customers": (50, 500), "calls": (5, 50), "priority": (0.4, 0.8),
        "fix_chance": 70,
    },
    "Cable Fault": {
        "codes": ("812.3", "813.1", "814.2", "815.5", "816.1"),
        "descriptions": (
            "Cable cut detected", "Fiber break in main trunk", "Coax cable degradation",
            "Underground cable damage", "Aerial cable fault",
        ),
        "severity": "High", "customer_impact": "Severe", "share": 10,
        "hours": (8.0, 48.0), "customers": (500, 5000), "calls": (50, 500), "priority": (0.7, 1.0),
        "fix_chance": 40,
    },
}

# --- rule thresholds --------------------------------------------------------
# fixed values: (category, code prefixes, customers above, calls above), first match wins
CLASSIFIER = (
    ("Cable Fault", ("81",), 1000, 100),
    ("Major", ("6", "7", "8", "9"), 100, 10),
)
CLASSIFIER_DEFAULT = "Minor"

# fixed values: priority score, in exact decimals
BASE_SCORE = {"Cable Fault": "0.8", "Major": "0.5", "Minor": "0.2"}
BASE_SCORE_DEFAULT = "0.1"
CUSTOMER_WEIGHT, CUSTOMER_LIMIT = "0.001", "0.2"
CALL_WEIGHT, CALL_LIMIT = "0.01", "0.1"
BUSINESS_BOOST = "0.1"
VENDOR_BOOST = (("Cisco", "0.05"), ("Nokia", "0.05"))

# fixed values: risk bands, strict lower bounds
RISK_BANDS = ((0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"))
RISK_DEFAULT = "LOW"

# fixed values: hours allowed per category; and the score/hours pair of the field preset
SLA_HOURS = {"Cable Fault": 4, "Major": 2, "Minor": 1}
SLA_SCORE, SLA_SCORE_HOURS = 0.7, 4

# fixed values: business hours, both ends included
BUSINESS_HOURS = (8, 17)

# fixed values: technician, skills, hours, tools per category
TECHNICIAN_SPECIALIST, TECHNICIAN_SENIOR, TECHNICIAN_GENERAL = "Specialist", "Senior", "General"
SENIOR_SCORE = 0.7
DISPATCH = {
    "Cable Fault": {
        "skills": ("Cable Splicing", "TDR Operation", "Excavation Safety"),
        "hours": 6.0,
        "tools": ("TDR", "Spectrum Analyzer", "Splice Kit", "Excavation Tools"),
    },
    "Major": {
        "skills": ("Router Configuration", "Fiber Optics", "Network Troubleshooting"),
        "hours": 3.0,
        "tools": ("Optical Power Meter", "Laptop", "Console Cable"),
    },
}
DISPATCH_DEFAULT = {
    "skills": ("Basic RF Knowledge", "Equipment Operation"),
    "hours": 1.5,
    "tools": ("Signal Level Meter", "Laptop"),
}

# fixed values: equipment reliability bands (faults above, label, risk range)
RELIABILITY_BANDS = ((10, "High", (0.7, 1.0)), (5, "Medium", (0.3, 0.7)))
RELIABILITY_DEFAULT = ("Low", (0.0, 0.3))
INSTALL_DAYS, MAINTENANCE_DAYS = (365, 1095), (30, 180)

# --- documents --------------------------------------------------------------
# fixed values
CHUNK_SIZE = 200
CHUNK_MIN_LENGTH = 10
SEARCH_MIN_LENGTH = 20
CHUNK_TYPES = (
    ("SAFETY", "SAFETY"), ("DIAGNOSTIC", "DIAGNOSTIC"), ("PROCEDURE", "PROCEDURE"),
    ("VERIFICATION", "VERIFICATION"), ("REPAIR", "PROCEDURE"),
)
CHUNK_TYPE_DEFAULT = "CONTENT"
SECTION_NAMES = (
    ("SAFETY", "Safety Requirements"), ("DIAGNOSTIC", "Diagnostic Steps"),
    ("PROCEDURE", "Repair Procedure"), ("VERIFICATION", "Verification Steps"),
)
SECTION_DEFAULT = "General Content"
CONTEXT_TYPE_ORDER = ("SAFETY", "DIAGNOSTIC", "PROCEDURE", "VERIFICATION")

# fixed values: relevance of each kind of hit, best first
SCORE_TEXT, SCORE_FIRST_WORD, SCORE_SECTION, SCORE_TITLE, SCORE_NONE = 0.9, 0.7, 0.6, 0.5, 0.3

# fixed values: procedure line parser
STEP_SECTIONS = (
    ("safety", ("SAFETY",)), ("diagnostic", ("DIAGNOSTIC",)),
    ("repair", ("REPAIR", "RESOLUTION")), ("verification", ("VERIFICATION",)),
)
STEP_MARKS = ("1.", "2.", "3.", "4.", "5.", "-")
NUMBER_MARKS = ("1.", "2.", "3.", "4.", "5.", "6.", "7.", "8.", "9.")
HEADER_MAX = 50

# fixed values: document match, in tenths
MATCH_CODE, MATCH_EQUIPMENT, MATCH_CONTENT = 8, 6, 4

# fixed values: time and tools of a repair
REPAIR_TIME = {
    "Cable Fault": ("4-8 hours", ("TDR", "Spectrum Analyzer", "Splice Kit", "Excavation Tools")),
    "Major": ("2-4 hours", ("Optical Power Meter", "Laptop", "Console Cable")),
}
REPAIR_TIME_DEFAULT = ("30 minutes - 1 hour", ("Signal Level Meter", "Laptop"))

# fixed values: the procedure used when no document matches
GENERIC = {
    "document_id": "GENERIC",
    "title": "Generic Repair Procedure",
    "safety": (
        "Ensure proper PPE (hard hat, safety vest, gloves)",
        "Check for electrical hazards before starting work",
        "Establish safety perimeter around work area",
        "Verify equipment is properly grounded",
    ),
    "diagnostic": (
        "Review fault description and error codes",
        "Check system alarms and status indicators",
        "Perform initial visual inspection",
        "Test signal levels and connectivity",
    ),
    "repair": (
        "Follow manufacturer guidelines for the equipment",
        "Replace or repair faulty components as needed",
        "Ensure all connections are secure",
        "Update system configuration if required",
    ),
    "verification": (
        "Test system functionality after repair",
        "Verify signal levels are within specifications",
        "Check for any remaining alarms or errors",
        "Document repair actions and test results",
    ),
    "time": "2-4 hours",
    "tools": ("Standard toolkit", "Multimeter", "Signal analyzer"),
    "content": "Generic repair procedure for ",
}

# fixed values: repair text template; {code}, {equipment}, {fault} are filled per row
REPAIR_TEMPLATE = """SIMULATED REPAIR PROCEDURE:

1. SAFETY REQUIREMENTS:
   - Ensure proper PPE (hard hat, safety vest, gloves)
   - Check for electrical hazards
   - Establish safety perimeter

2. DIAGNOSTIC STEPS:
   - Verify fault code: {code}
   - Check equipment: {equipment}
   - Assess fault: {fault}

3. REPAIR PROCEDURE:
   - Isolate affected components
   - Replace or repair faulty parts
   - Test system functionality

4. VERIFICATION STEPS:
   - Confirm fault resolution
   - Monitor system performance
   - Document repair completion

NOTE: This is a simulated procedure. Use SEARCH_SOP_CHUNKS for actual documentation."""

# fixed values: chat answer template and its not-found text
ANSWER_TEMPLATE = """Based on our technical documentation, here's what I found:

**Source:** {title} ({document})
**Confidence:** {confidence}
**Category:** {category}

**Answer:**
{excerpt}

Would you like me to provide the complete step-by-step procedure?"""
ANSWER_NONE = (
    "I couldn't find specific information about that issue. Please try rephrasing your question "
    "or contact technical support for assistance."
)

# fixed values: the five procedure documents of the catalog
SOP_TITLES = (
    "Cable Fault Resolution Procedures", "Service Degradation Troubleshooting",
    "Signal Level Adjustment Procedures", "Emergency Network Response Procedures",
    "Network Security Incident Response",
)
SOP_CATEGORIES = ("Cable Fault", "Major", "Minor", "Emergency", "Security")
SOP_EQUIPMENT = (
    ("Cisco cBR-8", "Arris E6000", "Casa C100G"),
    ("Nokia 7750", "Juniper MX960", "Cisco ASR9000"),
    ("Casa C100G", "Harmonic CableOS", "Cisco cBR-8"),
    ("All Network Equipment",),
    ("Firewalls", "Routers", "Switches", "Monitoring Systems"),
)
SOP_CODES = (
    ("812.3", "813.1", "814.2", "815.5", "816.1"),
    ("600.1", "700.2", "800.3", "900.1"),
    ("100.1", "200.2", "300.5", "400.1", "500.3"),
    ("EMERGENCY", "CRITICAL", "OUTAGE"),
    ("SEC-001", "SEC-002", "SEC-003"),
)
SOP_PAGES = (8, 6, 4, 12, 10)
SOP_WORDS = (1200, 950, 650, 1800, 1400)

# fixed values: characters a general-purpose strip() removes
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# fixed values: column names accepted in place of the canonical ones
TIMESTAMP_NAMES = ("fault_timestamp", "timestamp", "created_at", "fault_time")
RESOLUTION_NAMES = ("resolution_timestamp", "resolved_at", "resolution_time")
