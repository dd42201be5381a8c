"""Literal tables: detection patterns, verification rules, label catalogue, prompt text.

Everything here is data, not logic. Operators turn these rows into Catalyst expressions
(``CASE``/``rlike``/``regexp_extract_all``) or into small broadcast DataFrames, and the
DuckDB oracle in ``plans.oracle`` renders the very same rows into SQL, so the two engines
evaluate one rule set.

Regex dialect: every pattern must mean the same thing in Java regex (Spark) and RE2
(DuckDB): ASCII classes only, no ``\\b``, no ``\\s``, no ``.``, no look-around, no
possessive quantifiers.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------
# Candidate detection (J-01). (entity_type, label, pattern, group)
# Our own patterns, shaped after the value formats the reference's generators emit.
# ---------------------------------------------------------------------------------------
DETECTION_RULES: list[tuple[str, str, str, int]] = [
    ("EMAIL", "Email Address",
     r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0),
    ("PHONE", "Phone Number",
     r"(?:\+?1[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}", 0),
    ("SSN", "Social Security Number", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0),
    ("IPV4", "IP Address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0),
    ("CARD", "Card Number", r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", 0),
    ("IBAN", "Bank Account Details", r"[A-Z]{2}[0-9]{20}", 0),
    ("SWIFT_CODE", "SWIFT Code", r"[A-Z]{6}[A-Z0-9]{5}", 0),
    ("CRYPTO", "Crypto Wallet Address",
     r"(?:bc1|[13])[a-km-zA-HJ-NP-Z1-9]{33}|0x[0-9a-fA-F]{40}", 0),
    ("MRN", "Medical Record Number", r"MRN-[0-9]{6}", 0),
    ("SECRET", "Access Token",
     r'(?i)(?:token|secret|api[_-]?key|password|passwd)[ \t]*[:=][ \t]*"([^"\n]{8,})"', 1),
]

# Cheap pre-checks: a rule's regex only runs on texts containing one of these literals
# (lower-cased text for case-insensitive rules). A text without them cannot match, so the
# result is unchanged; only the regex scan is skipped. (entity_type -> (needles, lower))
DETECTION_NEEDLES: dict[str, tuple[list[str], bool]] = {
    "EMAIL": (["@"], False),
    "MRN": (["MRN-"], False),
    "SECRET": (["token", "secret", "apikey", "api_key", "api-key", "password", "passwd"], True),
}

# Shared gates: a rule runs only on texts matching its gate regex, evaluated once per text
# for all rules that share it. Every match of the rule contains a match of the gate, so
# results are unchanged. (Three consecutive digits occur in under 5 % of the driver's
# documents; phone, SSN, card and IBAN values all contain them.)
DETECTION_GATES: dict[str, str] = {
    "PHONE": "[0-9]{3}",
    "SSN": "[0-9]{3}",
    "CARD": "[0-9]{3}",
    "IBAN": "[0-9]{3}",
}

# Token edges: a match is dropped where the two characters before or after it match these.
_WORD_EDGES = (r"[0-9A-Za-z]\z", r"^[0-9A-Za-z]")
_NUMBER_EDGES = (r"[0-9A-Za-z]\z|[0-9][.-]\z", r"^[0-9A-Za-z]|^[.-][0-9]")
DETECTION_EDGES: dict[str, tuple[str, str]] = {
    "EMAIL": _WORD_EDGES, "IBAN": _WORD_EDGES, "SWIFT_CODE": _WORD_EDGES, "CRYPTO": _WORD_EDGES, "MRN": _WORD_EDGES,
    "PHONE": _NUMBER_EDGES, "SSN": _NUMBER_EDGES, "IPV4": _NUMBER_EDGES, "CARD": _NUMBER_EDGES,
}

# Characters that follow the value within the match, for rules that capture a group
DETECTION_TAILS: dict[str, int] = {"SECRET": 1}

ENTITY_TYPES = [r[0] for r in DETECTION_RULES]
TYPE_TO_LABEL = {r[0]: r[1] for r in DETECTION_RULES}

# ---------------------------------------------------------------------------------------
# Rule verifier (J-03 guards, J-04 three tests). (entity_type, test, scope, pattern,
# outcome, reason). test: guard | own | spec | ctx. scope: value | context |
# context_absent | after (text right after the value) | luhn_fail. The first matching rule of a test decides it; a guard hit
# makes all three tests false. Our own wording.
# ---------------------------------------------------------------------------------------
_NAME_EDGE_L = r"(?:^|[^A-Za-z])"
_NAME_EDGE_R = r"(?:[^A-Za-z]|$)"

#: words that make a person's name that of a school or venue
PLACES = ["School", "University", "College", "Kindergarten", "Polytechnic", "Museum", "Park", "Bridge", "Theatre",
          "Clinic", "Hospital", "Library", "Station", "Gallery", "Foundation"]

VERIFY_RULES: list[tuple[str, str, str, str, bool, str]] = [
    # EMAIL
    ("EMAIL", "guard", "value", r"(?i)^(?:no-?reply|donotreply|username|user|name|someone|yourname)@",
     False, "Placeholder or no-reply mailbox"),
    ("EMAIL", "guard", "context",
     r"(?i)(?:format|syntax|template|e\.g\.|example:|not a real|for reference|placeholder)",
     False, "Documentation or format example"),
    ("EMAIL", "own", "value",
     r"(?i)^(?:info|support|admin|sales|help|contact|team|office|billing|service|hr|jobs|careers|marketing|webmaster|postmaster|security)@",
     False, "Role mailbox of an organisation"),
    ("EMAIL", "own", "value", r"^[A-Za-z]+[._-][A-Za-z0-9]+@", True,
     "Username follows a personal name pattern"),
    ("EMAIL", "spec", "value",
     r"(?i)^(?:info|support|admin|sales|help|contact|team|office|billing|service)@",
     False, "Shared team alias"),
    ("EMAIL", "spec", "value", r"(?i)@(?:gmail|yahoo|outlook|hotmail|icloud|proton|mail[0-9]*)\.",
     True, "Personal mailbox provider"),
    ("EMAIL", "ctx", "context", r"(?i)(?:notification|automated|mailer-daemon|alerts)",
     False, "System or automated use"),
    ("EMAIL", "ctx", "context", r"(?i)(?:contact|email|reach|write to|profile|customer|patient|employee)",
     True, "Used to reach an individual"),
    # PHONE
    ("PHONE", "guard", "value", r"^(?:\+?1[ .-])?\(?8(?:00|33|44|55|66|77|88)\)?[ .-]",
     False, "Toll-free number (organisation line)"),
    ("PHONE", "guard", "context",
     r"(?i)(?:fax|hotline|switchboard|general line|main line|call cent(?:er|re)|customer service|help ?desk)",
     False, "Business or service line"),
    ("PHONE", "own", "context", r"(?i)(?:mobile|cell|home|personal|my number|call me|text me)",
     True, "Personal line"),
    ("PHONE", "spec", "context", r"(?i)(?:department|reception|front desk|team line)",
     False, "Shared department number"),
    ("PHONE", "ctx", "context", r"(?i)(?:patient|customer|employee|contact|emergency|profile)",
     True, "Contact detail of a person"),
    # SSN
    ("SSN", "guard", "value", r"^(?:000|666|9[0-9]{2})-|-00-|-0000$", False,
     "Outside the issued number ranges"),
    ("SSN", "guard", "context", r"(?i)(?:ticket|bug|error|pattern|format|staging)", False,
     "System identifier or format example"),
    ("SSN", "own", "context", r"(?i)(?:patient|employee|applicant|ssn|social security)", True,
     "Identifier issued to one person"),
    ("SSN", "spec", "value", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", True, "Unique national identifier"),
    # IPV4
    ("IPV4", "guard", "value",
     r"^(?:10\.|127\.|0\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|2(?:2[4-9]|[3-5][0-9])\.)",
     False, "Private, loopback or reserved address"),
    ("IPV4", "guard", "context",
     r"(?i)(?:server|gateway|router|localhost|dns|proxy|firewall|subnet|load balancer)",
     False, "Infrastructure address"),
    ("IPV4", "own", "context",
     _NAME_EDGE_L + r"(?:user|customer|visitor|client|login|his|her|my)" + _NAME_EDGE_R, True,
     "Address tied to a user session"),
    ("IPV4", "ctx", "context", r"(?i)(?:version|build|release)", False,
     "Version string, not an address"),
    # CARD
    ("CARD", "guard", "luhn_fail", "", False, "Fails the card checksum"),
    ("CARD", "guard", "context", r"(?i)(?:order|invoice|tracking|serial|sku|reference|ticket)",
     False, "Reference number, not a card"),
    ("CARD", "own", "context", r"(?i)(?:card|visa|mastercard|amex|cardholder|payment)", True,
     "Payment card of a person"),
    ("CARD", "spec", "value", r"^[0-9 -]+$", True, "Valid card number"),
    # IBAN
    ("IBAN", "own", "context", r"(?i)(?:account|iban|pay|salary|transfer)", True,
     "Bank account of a person"),
    ("IBAN", "spec", "value", r"^[A-Z]{2}[0-9]{20}$", True, "Unique account number"),
    # SWIFT_CODE
    ("SWIFT_CODE", "guard", "context_absent", r"(?i)(?:swift|bic|bank|transfer|wire)", False,
     "Upper-case word without banking context"),
    ("SWIFT_CODE", "own", "context", r"(?i)(?:account|beneficiary|payee)", True,
     "Bank code on a personal transfer"),
    # CRYPTO
    ("CRYPTO", "guard", "context", r"(?i)(?:token|hash|sha|commit|checksum)", False,
     "Part of a hash or token"),
    ("CRYPTO", "guard", "context_absent", r"(?i)(?:wallet|bitcoin|btc|ethereum|eth|crypto|address)",
     False, "No wallet context"),
    ("CRYPTO", "spec", "value", r"^(?:bc1|[13]|0x)", True, "Unique wallet address"),
    # MRN
    ("MRN", "own", "context", r"(?i)(?:patient|mrn|medical|record)", True,
     "Record number of one patient"),
    ("MRN", "spec", "value", r"^MRN-[0-9]{6}$", True, "Unique record number"),
    # PERSON (generated entity records)
    ("PERSON", "guard", "after",
     r"^ (?:[A-Z][a-z]+ )?(?:" + "|".join(PLACES) + ")",
     False, "Name of a school, building or venue"),
    ("PERSON", "own", "context", r"(?i)(?:dr\.|mr\.|ms\.|mrs\.|patient|employee)", True,
     "Title or role of a person"),
    ("PATIENT", "own", "context", r"(?i)(?:patient|admitted|discharge|follow-up)", True,
     "Patient in a clinical record"),
    ("MEDICAL_RECORD_NUMBER", "spec", "value", r"^MRN-[0-9]{6}$", True, "Unique record number"),
    # SECRET
    ("SECRET", "guard", "value", r"(?i)^(?:x{4,}|\*{4,}|changeme|dummy|example|placeholder|test)",
     False, "Placeholder credential"),
    ("SECRET", "ctx", "context", r"(?i)(?:token|secret|password|key)", True,
     "Credential that grants access to an account"),
]

TESTS = ("own", "spec", "ctx")
TEST_NAMES = {"own": "OWNERSHIP", "spec": "SPECIFICITY", "ctx": "CONTEXT"}

# Label-level guards on the whole text, for labels the detector cannot locate (J-03 sentence
# families: ticket ids, product/building/school names, company dates, non-credit scores,
# product/error/status codes). (label, pattern, reason)
LABEL_GUARDS: list[tuple[str, str, str]] = [
    ("Social Security Number", r"(?i)(?:SSN-[A-Z0-9]+-[A-Z0-9]+|###-##-####)",
     "System identifier or format example"),
    ("First Name", r"(?i)(?:product name|building name|school name|brand)",
     "Product, building or school name"),
    ("Date of Birth", r"(?i)(?:founded|release date|launch)", "Company or product date"),
    ("Credit Score", r"(?i)(?:test score|game score|quality score)", "Score of a test or game"),
    ("Employee Code", r"(?i)(?:product code|error code|status code|sku)",
     "Product, error or status code"),
    ("IP Address", r"(?i)(?:server|localhost|gateway|subnet)", "Infrastructure address"),
    ("Phone Number", r"(?i)(?:toll-free|1-800|fax|emergency services)", "Service or toll-free line"),
    ("Email Address", r"(?i)(?:noreply|format|syntax)", "Documentation or no-reply mailbox"),
]

# ---------------------------------------------------------------------------------------
# Label catalogue (A-09, D-03). The reference ships no catalogue file; names come from its
# generators and sample records, categories from its summary, descriptions are ours.
# (name, category, description)
# ---------------------------------------------------------------------------------------
LABEL_CATALOGUE: list[tuple[str, str, str]] = [
    ("Academic Transcripts", "Professional & Employment Background", "Grades and course records of a student."),
    ("Access Token", "Online Identifiers", "Secret credential or API token that grants access to an account."),
    ("Address", "Location Data", "Postal or street address of a home or person."),
    ("Bank Account Details", "Financial Data", "Account or IBAN number that identifies a personal bank account."),
    ("Benefits", "Professional & Employment Background", "Employee benefits such as insurance or leave entitlements."),
    ("Card Issuer", "Financial Data", "Bank or network that issued a payment card."),
    ("Card Number", "Financial Data", "Primary account number printed on a payment card."),
    ("Cookies", "Online Identifiers", "Browser cookie values that track one visitor."),
    ("Credit Score", "Financial Data", "Credit rating computed for one borrower."),
    ("Criminal Records History", "Personal Identification", "Past convictions or charges of a person."),
    ("Crypto Wallet Address", "Financial Data", "Bitcoin or Ethereum address that receives funds."),
    ("Date of Birth", "Personal Identification", "Calendar date on which a person was born."),
    ("Device Identifier", "Online Identifiers", "Hardware or advertising id of a personal device."),
    ("Disability or Specific Condition", "Health Data", "Disability or long-term condition of a person."),
    ("Educational History", "Professional & Employment Background", "Schools attended and degrees earned."),
    ("Email Address", "Contact Data", "Mailbox address that reaches one person."),
    ("Emergency Contact Details", "Contact Data", "Name and number of a person to call in an emergency."),
    ("Employee Code", "Professional & Employment Background", "Identifier an employer assigns to one employee."),
    ("Expenses", "Financial Data", "Amounts a person spent or claimed."),
    ("First Name", "Personal Identification", "Given name of a person."),
    ("Gender", "Personal Identification", "Gender identity of a person."),
    ("Height", "Biometric Data", "Body height of a person."),
    ("IP Address", "Online Identifiers", "Network address of a device used by a person."),
    ("Illness or Medical Condition", "Health Data", "Diagnosis, disease or symptom of a person."),
    ("Insurance Number", "Health Data", "Policy or member number of an insurance plan."),
    ("Last Name", "Personal Identification", "Family name of a person."),
    ("Medical Certificates", "Health Data", "Doctor's notes or certificates about a person's health."),
    ("Medical Record Number", "Health Data", "Hospital record number of one patient."),
    ("Nationality", "Personal Identification", "Citizenship or national origin of a person."),
    ("Order Details", "Purchase Data", "Items, amounts and dates of a customer's order."),
    ("Past Employers", "Professional & Employment Background", "Companies a person worked for."),
    ("Past Roles or Positions", "Professional & Employment Background", "Job titles a person held."),
    ("Payment Mode", "Purchase Data", "Payment method a customer used."),
    ("Payroll Information", "Financial Data", "Pay slips, pay period and deductions of an employee."),
    ("Phone Number", "Contact Data", "Telephone number that reaches one person."),
    ("Racial or Ethnic Origin", "Personal Identification", "Race or ethnicity of a person."),
    ("Retirement Account Information", "Financial Data", "Pension or retirement plan details."),
    ("SWIFT Code", "Financial Data", "Bank identifier code used on a transfer."),
    ("Salary", "Financial Data", "Pay or compensation of a person."),
    ("Sexual Orientation", "Personal Identification", "Sexual orientation of a person."),
    ("Social Security Number", "Personal Identification", "National insurance or social security number."),
    ("Stock or Equity Grants", "Financial Data", "Shares or options granted to an employee."),
    ("Tax Information", "Financial Data", "Tax identifiers, returns or liabilities of a person."),
    ("VPA Address", "Financial Data", "Virtual payment address of a person."),
    ("Weight", "Biometric Data", "Body weight of a person."),
]

# ---------------------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# ---------------------------------------------------------------------------------------

# Reply parsing, simple mode (P-10, P-12): garbage prefixes in list order and stop words.
GARBAGE_PREFIXES = ["none your response", "i apologize", "let me analyze", "here is",
                    "the verified", "answer:", "response:"]
STOP_WORDS = ["apologize", "analyze", "response", "superf00k"]

# Reply parsing fallback reasons (P-03, P-04, P-06, P-07, P-08, P-09) and defaults (P-01).
REASON_EMPTY_REPLY = "LLM failed to provide valid JSON response"
REASON_BAD_STRUCTURE = "Parse error - unexpected JSON structure"
REASON_NO_JSON = "No valid JSON in response"
REASON_DECODE_FAILED = ("JSON parsing failed - conservatively marking as verified "
                        "(privacy-first approach)")
REASON_SINGLE_DEFAULT = "LLM verification"
REASON_SINGLE_TEXT = "Parsed from LLM text response"

# Description lookup (D-03).
NO_DESCRIPTION = "No description available."
NO_PIIS = "No PIIs detected."

# Consolidation (C-05, C-13, I-13).
CONSOLIDATE_NA = "N/A"
CONSOLIDATE_NOT_PROCESSED = "Not processed by this model"
CONSOLIDATE_NO_REASON = "No reason provided"

# Span-verifier entity-type aliases (I-20), upper-cased key -> scorer label.
TYPE_ALIASES = {
    "CRYPTO": "cryptocurrency address",
    "BITCOIN": "bitcoin address",
    "ETHEREUM": "ethereum address",
    "IBAN": "IBAN",
    "SWIFT_CODE": "SWIFT code",
    "SWIFT": "SWIFT code",
    "BIC": "BIC code",
    "ROUTING_NUMBER": "routing number",
    "BANK_ACCOUNT": "bank account",
    "CREDIT_CARD": "credit card",
}

# JSON template -> domain (J-15), default "technology".
TEMPLATE_DOMAINS = {
    "user_profile": "technology",
    "employee_record": "hr",
    "ecommerce_order": "ecommerce",
    "hubspot_contact": "marketing",
    "slack_message": "slack",
    "resume_json": "resume",
    "healthcare_record": "healthcare",
    "financial_account": "finance",
}

# ---------------------------------------------------------------------------------------
# Prompt text (J-05, J-06). Our own wording; placeholders are replaced literally, never
# through a format function, so braces in the text are safe.
# ---------------------------------------------------------------------------------------
SINGLE_PROMPT = """Is this detector finding the personal data of somebody?

Finding: {entity_value} (reported as {entity_type})
Passage it was found in: {context}

Say no if the passage uses it for a place, an institution, a product, a machine or as documentation;
say yes if it leads to one living person. Your whole answer is one line of JSON with the keys
verified (true or false), confidence (a number from 0 to 1) and reason (a few words)."""

BATCH_PROMPT = """Privacy review of automatic findings

Findings to judge: {detected_piis}

What the types stand for:
{element_descriptions}

Passage under review, between the rulers:
-----
{input_text}
-----

For each finding ask in turn:
1. OWNERSHIP: whose is it? One person's, or that of a company, a role or a machine?
2. SPECIFICITY: how many people share it? Only a value that leads to a single person is specific.
3. CONTEXT: what does the passage use it for? To deal with a person, or to describe a technical or business matter?
One answer in favour of a person is enough to count the finding as VERIFIED, and so is doubt. Three answers against make it REJECTED.

How to answer:
{response_rules}

{output_example}
"""

REASONING_RULES = """CRITICAL: a strict parser takes everything from your opening brace to your closing brace as valid JSON in the EXACT format
of the sample. It gives up on names without double quotes, on quotes inside a text that are not escaped and on trailing commas."""

REASONING_EXAMPLE = """{
  "results": [
    {"pii": "Salary", "verified": true, "reason": "pay of the named clerk"},
    {"pii": "IP Address", "verified": false, "reason": "address of a printer"}
  ]
}"""

SIMPLE_RULES = """Write the types of the VERIFIED findings on one line, comma-separated, and nothing else.
If there are none, write NONE."""

SIMPLE_EXAMPLE = """Salary, Date of Birth"""
