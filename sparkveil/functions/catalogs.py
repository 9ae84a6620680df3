"""Pattern catalogs: what to look for, kept as plain data.

A catalog is a list of :class:`Pattern`.  The detection operators turn each
entry into one native regular-expression pass over the text column.

``guard`` names a cheap pre-test (see ``match.GUARDS``) that must hold for the
pattern to be able to match; documents failing it skip the expensive pass.
Guards are necessary conditions only, they never change a result; so are the
pieces of ``need``, one of which must stand in the text or a reduced form of it.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Pattern(NamedTuple):
    type: str
    regex: str
    ignore_case: bool = False
    category: str | None = None
    label: str | None = None
    confidence: float = 0.5
    priority: int = 0
    guard: str | None = None
    group: int = 0  # 1 when the value is the first capture group
    need: tuple[str, tuple[str, ...]] | None = None  # a reduced form of the text (``match.FORMS``) and pieces, one of which it must hold
    ours: bool = False  # of the catalogs below: matches the same in ASCII texts without Unicode classes


# ---------------------------------------------------------------------------
# Shape catalog, in scan order.
# (type, regex, ignore case, capture group of the value, base confidence, guard)
# ---------------------------------------------------------------------------
SHAPES = [
    ("AADHAAR", r"\b(?:\d{4}[-\s]?\d{4}[-\s]?\d{4}|\d{12})\b", True, 0, 0.95, "digit4"),
    ("PAN", r"\b([A-Z]{5}\d{4}[A-Z])\b", False, 1, 0.9, "digit4"),
    ("PASSPORT", r"\b([A-Z]\d{7})\b", False, 1, 0.9, "digit4"),
    ("VOTER_ID", r"\b([A-Z]{3}\d{7})\b", False, 1, 0.85, "digit4"),
    ("DRIVING_LICENSE", r"\b([A-Z]{2}\s*\d{2}\s*\d{4,11}|\w{2}\d{13})\b", False, 1, 0.85, "digit4"),
    ("IFSC", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", False, 1, 0.9, "digit"),
    ("GSTIN", r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b", False, 1, 0.9, "digit4"),
    ("CIN", r"\b([LUCFWB]\d{5}[A-Z]{2}\d{4}PTC\d{6})\b", False, 1, 0.9, "digit4"),
    ("EPF", r"\b([A-Z]{2}\d{7,10})\b", False, 1, 0.8, "digit4"),
    ("RATION_CARD", r"\b([A-Z]{2}\d{10,12})\b", False, 1, 0.8, "digit4"),
    ("CARD_NUMBER", r"\b(?:\d{4}[-\s]?){3}\d{4}|\d{15,19}\b", False, 0, 0.85, "digit4"),
    ("CARD_EXPIRY", r"\b((?:0[1-9]|1[0-2])[/\-\s]?(?:\d{2}|\d{4}))\b", False, 1, 0.85, "digit"),
    ("BANK_ACCOUNT", r"\b(\d{10,18})\b", False, 1, 0.75, "digit4"),
    ("UPI", r"\b([A-Za-z0-9._\-]{2,256}@(?!gmail\.com|yahoo\.(?:com|in|co\.in)|outlook\.com|hotmail\.(?:com|in))[a-z0-9._\-]{2,64})\b", True, 1, 0.8, "at"),
    ("EMAIL", r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b", False, 1, 0.85, "at"),
    ("PHONE", r"\b(?:\+91[\-\s]?|91[\-\s]?|0)?([6-9]\d{9})\b", False, 1, 0.8, "digit4"),
    ("PINCODE", r"\b(\d{6})\b", False, 1, 0.8, "digit4"),
    ("DOB", r"\b([0-3]?\d[\/\-\.\s][0-1]?\d[\/\-\.\s](?:\d{4}|\d{2}))\b", False, 1, 0.75, "digit"),
    ("IMEI", r"\b(\d{14,16})\b", False, 1, 0.8, "digit4"),
    ("IPV4", r"\b(?:(?:192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)(?:\d{1,3}\.){2}\d{1,3}|(?:\d{1,3}\.){3}\d{1,3})\b", False, 0, 0.7, "digit"),
    ("IPV6", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", False, 0, 0.7, "colon"),
    ("MAC", r"\b([0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5})\b", False, 1, 0.7, "mac"),
    ("API_KEY", r"\b([A-Za-z0-9\-_]{16,128})\b", False, 1, 0.7, "run16"),
    ("EMPLOYEE_ID", r"\b(EMP\d{4})\b", False, 1, 0.9, "digit4"),
    ("STUDENT_ROLL", r"\b(SR(?:202[0-4])\d{5})\b", False, 1, 0.9, "digit4"),
    ("TRANSACTION_ID", r"\b(TXN\d{8})\b", False, 1, 0.9, "digit4"),
    ("CUSTOMER_ID", r"\b(CUST\d{6})\b", False, 1, 0.9, "digit4"),
    ("ORDER_ID", r"\b(ORD\d{8})\b", False, 1, 0.9, "digit4"),
    ("MEDICAL_RECORD_ID", r"\b(MR\d{6})\b", False, 1, 0.9, "digit4"),
    ("INSURANCE_POLICY_NO", r"\b(IP\d{8})\b", False, 1, 0.9, "digit4"),
    ("VEHICLE_REG_NO", r"\b([A-Z]{2}\d{2}\s?[A-Z]{2}\s?\d{4})\b", False, 1, 0.85, "digit4"),
    ("TAX_RECORD", r"\b(TAX\d{7})\b", False, 1, 0.9, "digit4"),
    ("MEMBERSHIP_ID", r"\b(MID\d{5})\b", False, 1, 0.9, "digit4"),
    ("PROJECT_CODE", r"\b(PRJ\d{4})\b", False, 1, 0.9, "digit4"),
    ("REFERRAL_CODE", r"\b([A-Z0-9]{6})\b", False, 1, 0.85, None),
    ("LICENSE_KEY", r"\b([A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4})\b", False, 1, 0.85, "dash"),
    ("DEVICE_ID", r"\b([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b", True, 1, 0.75, "dash"),
    ("SESSION_TOKEN", r"\b([0-9a-f]{32})\b", True, 1, 0.75, "run16"),
    ("SALARY", r"\b(₹\d{1,3}(?:,\d{2,3})*)\b", False, 1, 0.7, "rupee"),
    ("GPS", r"\b((?:[6-9]|[12][0-9]|3[0-7])\.[0-9]{1,6},(?:[6-8][0-9]|9[0-7])\.[0-9]{1,6})\b", False, 1, 0.6, "digit"),
    ("EMAIL_DOMAIN", r"@\b([A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b", False, 1, 0.5, "at"),
    ("SOCIAL_HANDLE", r"@\b([A-Za-z0-9._]{1,50})\b", False, 1, 0.5, "at"),
]

# Pieces that a match must leave in a reduced form of the text.
SHAPE_NEEDS = {
    "AADHAAR": ("packed", ("0" * 12,)), "PAN": ("shape", ("AAAAA0000A",)), "PASSPORT": ("shape", ("A0000000",)),
    "VOTER_ID": ("shape", ("AAA0000000",)), "DRIVING_LICENSE": ("packed", ("AA000000", "0" * 13)), "IFSC": ("shape", ("AAAA0",)),
    "GSTIN": ("shape", ("00AAAAA0000A",)), "CIN": ("shape", ("A00000AA0000AAA000000",)), "EPF": ("shape", ("AA0000000",)),
    "RATION_CARD": ("shape", ("AA0000000000",)), "CARD_NUMBER": ("packed", ("0" * 15,)), "BANK_ACCOUNT": ("shape", ("0" * 10,)),
    "PHONE": ("shape", ("0" * 10,)), "PINCODE": ("shape", ("000000",)), "IMEI": ("shape", ("0" * 14,)), "IPV4": ("shape", ("0.0",)),
    "EMPLOYEE_ID": ("text", ("EMP",)), "STUDENT_ROLL": ("text", ("SR202",)), "TRANSACTION_ID": ("text", ("TXN",)),
    "CUSTOMER_ID": ("text", ("CUST",)), "ORDER_ID": ("text", ("ORD",)), "MEDICAL_RECORD_ID": ("text", ("MR",)),
    "INSURANCE_POLICY_NO": ("text", ("IP",)), "VEHICLE_REG_NO": ("packed", ("AA00AA0000",)), "TAX_RECORD": ("text", ("TAX",)),
    "MEMBERSHIP_ID": ("text", ("MID",)), "PROJECT_CODE": ("text", ("PRJ",)), "GPS": ("shape", ("0,0",)),
}

# Order in which shapes claim a span, strongest first.
SHAPE_PRIORITY = [
    "AADHAAR", "PAN", "IFSC", "GSTIN", "CIN", "PASSPORT", "VOTER_ID",
    "DRIVING_LICENSE", "EPF", "RATION_CARD", "CARD_NUMBER",
    "CARD_EXPIRY", "BANK_ACCOUNT", "UPI", "EMAIL", "PHONE", "PINCODE",
    "EMPLOYEE_ID", "STUDENT_ROLL", "TRANSACTION_ID", "CUSTOMER_ID",
    "ORDER_ID", "MEDICAL_RECORD_ID", "INSURANCE_POLICY_NO", "TAX_RECORD",
    "MEMBERSHIP_ID", "PROJECT_CODE", "VEHICLE_REG_NO", "REFERRAL_CODE",
    "LICENSE_KEY", "DEVICE_ID", "SESSION_TOKEN", "SALARY", "GPS",
    "IMEI", "IPV4", "IPV6", "MAC", "API_KEY", "DOB",
    "EMAIL_DOMAIN", "SOCIAL_HANDLE",
]

# Words near a hit that raise its confidence (case-insensitive).
CONTEXT_WORDS = {
    "AADHAAR": r"\b(?:aadhaar|aadhar|uid)\b",
    "PAN": r"\b(?:pan|permanent\s+account)\b",
    "PASSPORT": r"\b(?:passport)\b",
    "VOTER_ID": r"\b(?:voter|epic)\b",
    "DRIVING_LICENSE": r"\b(?:driving|dl)\b",
    "BANK_ACCOUNT": r"\b(?:account|a/c|acct)\b",
    "IFSC": r"\b(?:ifsc)\b",
    "UPI": r"\b(?:upi|vpa)\b",
    "PHONE": r"\b(?:phone|mobile|tel|contact)\b",
    "EMAIL": r"\b(?:email|e-mail|mail)\b",
    "DOB": r"\b(?:dob|date\s+of\s+birth|birth\s+date|born|d\.o\.b)\b",
    "ADDRESS": r"\b(?:address|residence|location|addr)\b",
    "CARD_NUMBER": r"\b(?:card|card\s+number|card\s+no)\b",
    "CVV": r"\b(?:cvv|cvc)\b",
    "EMPLOYEE_ID": r"\b(?:employee|emp|staff)\b",
    "TRANSACTION_ID": r"\b(?:transaction|txn|reference)\b",
}

# A hit equal to one of these words is noise.
STOP_VALUES = ["my", "is", "id", "no", "pan", "email", "phone", "upi", "ifsc", "aadhaar"]

# ---------------------------------------------------------------------------
# Label catalog, in scan order.  Every pattern is matched
# case-insensitively and its value is the first capture group.
# (label, category, [patterns])
# ---------------------------------------------------------------------------
LABELS = [
    ("USERNAME", "Credentials", [
        r"(?:username|user\s*name|login\s*name|user\s*id)\s*[:=]\s*([^\n,;]+)",
        r"//\s*Username\s*[:=]\s*([^\n]+)",
        r"#\s*Username\s*[:=]\s*([^\n]+)"]),
    ("PASSWORD", "Credentials", [
        r"(?:password|passwd|pwd|pass)\s*[:=]\s*([^\n,;]+)",
        r"//\s*Password\s*[:=]\s*([^\n]+)",
        r"#\s*Password\s*[:=]\s*([^\n]+)"]),
    ("API_KEY", "Credentials", [
        r"(?:api[_\s]?key|secret[_\s]?key|token|access[_\s]?token)\s*[:=]\s*([^\n,;]+)",
        r"//\s*(?:API[_\s]?Key|apiKey)\s*[:=]\s*([^\n]+)",
        r"#\s*(?:API[_\s]?Key|apiKey)\s*[:=]\s*([^\n]+)"]),
    ("EMAIL", "Contact", [
        r"(?:email|e-mail|email\s*address|contact\s*email)\s*[:=]\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"]),
    ("PHONE", "Contact", [
        r"(?:phone|mobile|contact|tel|telephone)\s*[:=]\s*(\+?91[\s\-]?[6-9]\d{3}[\s\-]?\d{5}|\d{10,12})"]),
    ("NAME", "Personal", [r"(?:name|full\s*name|user\s*name)\s*[:=]\s*([A-Za-z\s]+)"]),
    ("DOB", "Personal", [
        r"(?:dob|date\s*of\s*birth|birth\s*date|born)\s*[:=]\s*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})"]),
    ("ADDRESS", "Personal", [r"(?:address|location|residence)\s*[:=]\s*([^\n;]+)"]),
    ("BANK_ACCOUNT", "Financial", [
        r"(?:account|account\s*number|bank\s*account|a/c)\s*[:=]\s*(\d{10,18})",
        r"//\s*(?:Account|Bank\s*details)\s*[:=]\s*(\d{10,18})",
        r"#\s*(?:Account|Bank\s*details)\s*[:=]\s*(\d{10,18})"]),
    ("IFSC", "Financial", [
        r"(?:ifsc|ifsc\s*code|IFSC)\s*[:=]\s*([A-Z]{4}0[A-Z0-9]{6})",
        r"IFSC\s*[:=]\s*([A-Z]{4}0[A-Z0-9]{6})",
        r"ifsc\s*[:=]\s*([A-Z]{4}0[A-Z0-9]{6})",
        r"//\s*IFSC\s*[:=]\s*([A-Z0-9]+)",
        r"#\s*IFSC\s*[:=]\s*([A-Z0-9]+)"]),
    ("UPI", "Financial", [r"(?:upi|upi\s*id|vpa)\s*[:=]\s*([a-zA-Z0-9._\-]+@[a-z0-9._\-]+)"]),
    ("CARD_NUMBER", "Financial", [
        r"(?:card|card\s*number|credit\s*card)\s*[:=]\s*(\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4})"]),
    ("SALARY", "Financial", [
        r"(?:salary|income|amount|compensation)\s*[:=]\s*(?:₹|Rs\.?)?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"]),
    ("AADHAAR", "Government ID", [
        r"(?:aadhaar|aadhar|uid)\s*[:=]\s*(\d{4}[\s\-]?\d{4}[\s\-]?\d{4}|\d{12})"]),
    ("PAN", "Government ID", [
        r"(?:pan|pan\s*number|permanent\s*account\s*number)\s*[:=]\s*([A-Z]{5}\d{4}[A-Z])"]),
    ("PASSPORT", "Government ID", [
        r"(?:passport|passport\s*number|passport\s*no)\s*[:=]\s*([A-Z]\d{7})"]),
    ("VOTER_ID", "Government ID", [
        r"(?:voter|voter\s*id|epic|voter\s*number)\s*[:=]\s*([A-Z]{3}\d{7})"]),
    ("DRIVING_LICENSE", "Government ID", [
        r"(?:driving\s*license|dl|license\s*number|license\s*no|dlno)\s*[:=]\s*([A-Z]{2}\s*\d{2}\s*\d{4,11}|\w{2}\d{13})"]),
    ("GSTIN", "Government ID", [
        r"(?:gstin|gst|gst\s*number)\s*[:=]\s*([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9])"]),
    ("CIN", "Government ID", [
        r"(?:cin|company\s*identification\s*number)\s*[:=]\s*([LUCFWB]\d{5}[A-Z]{2}\d{4}PTC\d{6})"]),
    ("EPF", "Government ID", [r"(?:epf|epf\s*number|provident\s*fund)\s*[:=]\s*([A-Z]{2}\d{7,10})"]),
    ("RATION_CARD", "Government ID", [
        r"(?:ration\s*card|ration\s*card\s*number)\s*[:=]\s*([A-Z]{2}\d{10,12})"]),
    ("EMPLOYEE_ID", "Employment", [
        r"(?:employee\s*id|emp\s*id|emp\s*no|staff\s*id|employee\s*number|empid)\s*[:=]\s*(EMP\d{4}|[A-Z]{2}\d{4})"]),
    ("STUDENT_ROLL", "Education", [
        r"(?:roll\s*(?:number|no)|student\s*id|roll|roll\s*no|admission\s*number)\s*[:=]\s*(SR(?:202[0-4])\d{5}|[A-Z]{3}\d{7})"]),
    ("CUSTOMER_ID", "Custom ID", [
        r"(?:customer\s*(?:id|number)|cust\s*(?:id|no))\s*[:=]\s*(CUST\d{6})"]),
    ("ORDER_ID", "Custom ID", [r"(?:order\s*(?:id|number)|order\s*no)\s*[:=]\s*(ORD\d{8})"]),
    ("TRANSACTION_ID", "Financial", [
        r"(?:transaction|txn|reference|ref|trans\s*id|transaction\s*number)\s*[:=]\s*(TXN\d{8}|[A-Z]{3}\d{6})"]),
    ("MEDICAL_RECORD_ID", "Medical", [
        r"(?:medical\s*record|mr\s*number|patient\s*id)\s*[:=]\s*(MR\d{6})"]),
    ("INSURANCE_POLICY", "Financial", [
        r"(?:insurance\s*policy|policy\s*(?:number|no)|policy\s*id)\s*[:=]\s*(IP\d{8})"]),
    ("VEHICLE_REG", "Government ID", [
        r"(?:vehicle\s*(?:number|registration)|vehicle\s*reg|reg\s*number)\s*[:=]\s*([A-Z]{2}\d{2}\s?[A-Z]{2}\s?\d{4})"]),
    ("TAX_RECORD", "Government ID", [r"(?:tax\s*record|tax\s*(?:id|number))\s*[:=]\s*(TAX\d{7})"]),
    ("MEMBERSHIP_ID", "Custom ID", [
        r"(?:membership\s*(?:id|number)|member\s*id)\s*[:=]\s*(MID\d{5})"]),
    ("PROJECT_CODE", "Custom ID", [r"(?:project\s*(?:code|id|number))\s*[:=]\s*(PRJ\d{4})"]),
    ("REFERRAL_CODE", "Custom ID", [
        r"(?:referral\s*(?:code|id)|ref\s*code)\s*[:=]\s*([A-Z0-9]{6})"]),
    ("LICENSE_KEY", "Custom ID", [
        r"(?:license\s*key|license|activation\s*key)\s*[:=]\s*([A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4})"]),
    ("DEVICE_ID", "Technical", [
        r"(?:device\s*(?:id|uuid)|device\s*number)\s*[:=]\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"]),
    ("SESSION_TOKEN", "Technical", [
        r"(?:session|token|session\s*token)\s*[:=]\s*([0-9a-f]{32})"]),
    ("IMEI", "Technical", [r"(?:imei|imei\s*number)\s*[:=]\s*(\d{14,16})"]),
    ("MAC_ADDRESS", "Technical", [
        r"(?:mac|mac\s*address|mac\s*id)\s*[:=]\s*([0-9A-Fa-f]{2}(?:[:\-][0-9A-Fa-f]{2}){5})"]),
    ("IPV4", "Technical", [
        r"(?:ip|ipv4|ip\s*address)\s*[:=]\s*(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"]),
    ("PINCODE", "Personal", [r"(?:pin(?:code)?|postal\s*code|zip\s*code)\s*[:=]\s*(\d{6})"]),
    ("GPS", "Location", [
        r"(?:gps|location|coordinates|latitude\s*longitude)\s*[:=]\s*((?:[6-9]|[12][0-9]|3[0-7])\.[0-9]{1,6},(?:[6-8][0-9]|9[0-7])\.[0-9]{1,6})"]),
    ("GENDER", "Personal", [r"(?:gender|sex)\s*[:=]\s*(male|female|other|m|f|o)"]),
    ("EMPLOYER", "Employment", [
        r"(?:employer|company|organization|current\s*employer)\s*[:=]\s*([^\n,;]+)"]),
    ("COURSE", "Education", [
        r"(?:course|degree|program|qualification)\s*[:=]\s*((?:B\.?Tech|M\.?Tech|B\.?Sc|M\.?Sc|MBA|B\.?A|M\.?A|B\.?Com|M\.?Com)[^\n,;]*)"]),
    ("YEAR", "Education", [r"(?:year|academic\s*year|study\s*year)\s*[:=]\s*(\d{1,2})"]),
    ("SEMESTER", "Education", [r"(?:semester|sem)\s*[:=]\s*(\d{1,2})"]),
    ("GUARDIAN_NAME", "Personal", [
        r"(?:guardian|parent|mother|father|guardian\s*name|parent\s*name)\s*[:=]\s*([A-Za-z\s]+)"]),
    ("MERCHANT_ID", "Financial", [
        r"(?:merchant\s*(?:id|number)|merchant|merchantId)\s*[:=]\s*([A-Z0-9\"]{6,}|TXN\d{8})",
        r"merchantId\s*[:=]\s*[\"']?([TXN0-9]+)[\"']?",
        r"//\s*merchantId\s*[:=]\s*([^\n]+)",
        r"#\s*merchantId\s*[:=]\s*([^\n]+)"]),
    ("PAYMENT_METHOD", "Financial", [
        r"(?:payment\s*(?:method|mode)|payment)\s*[:=]\s*(UPI|Card|Cash|Bank\s*Transfer|Credit|Debit|NetBanking|PayPal)"]),
    ("RECEIPT_NUMBER", "Financial", [
        r"(?:receipt\s*(?:number|no)|receipt\s*id)\s*[:=]\s*(RCP-\d{5}|\d{6,})"]),
    ("INVOICE_NUMBER", "Financial", [
        r"(?:invoice\s*(?:number|no)|invoice\s*id|inv)\s*[:=]\s*(INV-\d{5}|\d{6,})"]),
    ("STATEMENT_PERIOD", "Financial", [
        r"(?:statement\s*(?:period|date)|statement\s*from)\s*[:=]\s*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\s*(?:to|to)\s*\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})"]),
    ("ACCOUNT_HOLDER", "Financial", [
        r"(?:account\s*holder|account\s*name)\s*[:=]\s*([A-Za-z\s]+)"]),
    ("DEVELOPER", "Employment", [
        r"(?:developer|author|created\s*by|developer\s*name)\s*[:=]\s*([A-Za-z\s]+)",
        r"//\s*Developer\s*[:=]\s*([^\n]+)",
        r"#\s*Developer\s*[:=]\s*([^\n]+)"]),
    ("CONTACT", "Personal", [
        r"(?:contact|contact\s*person|contact\s*name)\s*[:=]\s*([A-Za-z\s]+)"]),
    ("LAST_UPDATED", "Metadata", [
        r"(?:last\s*(?:updated|modified)|updated|modified)\s*[:=]\s*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})"]),
    ("VERSION", "Metadata", [r"(?:version|ver|v)\s*[:=]\s*([\d.]+)"]),
    ("APP_NAME", "Metadata", [
        r"(?:app\s*name|application\s*name|appname)\s*[:=]\s*([^\n,;]+)"]),
    ("TIME", "Metadata", [r"(?:time|timestamp)\s*[:=]\s*(\d{1,2}:\d{2}:\d{2})"]),
    ("AMOUNT", "Financial", [
        r"(?:amount|total|grand\s*total|balance)\s*[:=]\s*(?:₹|Rs\.?)?(\d{1,3}(?:,\d{2,3})*(?:\.\d{2})?)"]),
    ("GST", "Financial", [
        r"(?:gst|tax|goods\s*and\s*service\s*tax)\s*[:=]\s*(?:₹|Rs\.?)?(\d{1,3}(?:,\d{2,3})*(?:\.\d{2})?)"]),
    ("DEBIT_CREDIT", "Financial", [
        r"(?:debit|credit|transaction\s*type)\s*[:=]\s*(Debit|Credit)"]),
    ("LINKED_MOBILE", "Contact", [
        r"(?:linked\s*mobile|registered\s*mobile|mobile\s*number)\s*[:=]\s*(\+?91[\s\-]?[6-9]\d{3}[\s\-]?\d{5}|\d{10,12})"]),
    ("SUPPORT_PHONE", "Contact", [
        r"(?:support\s*phone|support\s*(?:number|contact)|helpline)\s*[:=]\s*(\+?91[\s\-]?[6-9]\d{3}[\s\-]?\d{5}|\d{10,12})"]),
    ("ADMIN_EMAIL", "Contact", [
        r"(?:admin\s*email|admin\s*contact|administrator\s*email|Contact)\s*[:=]\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
        r"//\s*(?:Contact|Admin\s*Email)\s*[:=]\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})",
        r"#\s*(?:Contact|Admin\s*Email)\s*[:=]\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"]),
    ("EMERGENCY_CONTACT", "Contact", [
        r"(?:emergency\s*(?:contact|number|phone))\s*[:=]\s*(\+?91[\s\-]?[6-9]\d{3}[\s\-]?\d{5}|\d{10,12})"]),
    ("ACCOUNT_NUMBER_FIELD", "Financial", [
        r"(?:account\s*number|a/c|account|acct)\s*[:=]\s*(\d{10,18})"]),
]

# ---------------------------------------------------------------------------
# Generic catalog, in scan order.  The value is the whole match.
# (type, label, category, regex, ignore case, guard)
# ---------------------------------------------------------------------------
GENERIC = [
    ("Aadhaar", "Aadhaar Number", "Government ID", r"\b\d{4}\s?\d{4}\s?\d{4}\b", False, "digit4"),
    ("PAN", "PAN", "Government ID", r"\b[A-Z]{5}\d{4}[A-Z]{1}\b", False, "digit4"),
    ("Passport", "Passport Number", "Government ID", r"\bA\d{7}\b", False, "digit4"),
    ("VoterID", "Voter ID", "Government ID", r"\bEPIC/[A-Z]{3}\d{6}\b", False, "digit4"),
    ("DrivingLicense", "Driving License", "Government ID", r"\b[A-Z]{2}-\d{4}-\d{7}\b", False, "digit4"),
    ("BankAccount", "Bank Account Number", "Financial", r"(?:account|account\s*number|bank\s*account)[\s:]*(\d{10,18})\b", True, "digit4"),
    ("IFSC", "IFSC Code", "Financial", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", False, "digit"),
    ("UPIID", "UPI ID", "Financial", r"\b[a-z0-9]+@(paytm|ybl|okaxis|okhdfcbank|okicici)\b", True, "at"),
    ("CreditCard", "Credit Card Number", "Financial", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b", False, "digit4"),
    ("Phone", "Phone Number", "Contact", r"(?:phone|mobile|contact)[\s:]*(?:\+?91|0)?[\s\-]?[6-9]\d{3}[\s\-]?\d{5}\b", True, "digit4"),
    ("Email", "Email Address", "Contact", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", False, "at"),
    ("DOB", "Date of Birth", "Personal", r"(?:date\s*of\s*birth|dob|born)[\s:]*(\d{1,2}[-/]\d{1,2}[-/]\d{4})", True, "digit4"),
    ("Name", "Name", "Personal", r"(?:name|full\s*name|person)[\s:]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", True, None),
    ("Address", "Address", "Personal", r"(?:address|location)[\s:]*([A-Za-z0-9\s,#.-]+),\s*([A-Za-z\s]+)-?\s*(\d{6})", True, "digit4"),
    ("EmployeeID", "Employee ID", "Employment", r"(?:employee\s*id|emp[\s#]*)([A-Z]{2}\d{4})\b", True, "digit4"),
    ("StudentRoll", "Student Roll Number", "Education", r"(?:roll\s*(?:number|no)|student\s*id)[\s:]*([A-Z]{3}\d{7})\b", True, "digit4"),
    ("TransactionID", "Transaction ID", "Financial", r"(?:transaction|txn|reference)[\s#:]*([A-Z]{3}\d{6})\b", True, "digit4"),
    ("Salary", "Salary Amount", "Financial", r"(?:salary|income|amount)[\s:]*₹?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", True, "digit"),
    ("GPS", "GPS Coordinates", "Location", r"\b(\d{1,2}\.\d{6}),\s*(\d{1,2}\.\d{6})\b", False, "digit4"),
    ("APIKey", "API Key", "Credentials", r"(?:api[_-]?key|secret|token)[\s:]*['\"]?([a-zA-Z0-9_-]{20,})['\"]?", True, None),
    ("Username", "Username", "Credentials", r"(?:username|user)[\s:]*([a-zA-Z0-9_.-]+)", True, None),
    ("Password", "Password", "Credentials", r"(?:password|passwd|pwd)[\s:]*['\"]?([a-zA-Z0-9!@#$%^&*()_+-=\[\]{};:'\"<>?,./]{6,})['\"]?", True, None),
    ("GSTIN", "GSTIN", "Business ID", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]{1}\d[A-Z0-9]{1}\b", False, "digit4"),
    ("LinkedinProfile", "LinkedIn Profile", "Social Media", r"(?:linkedin|linkedin\.com|in\.com)[\s/]*(?:in/)?([a-z0-9-]+)", True, None),
]

# Pieces that a match must leave in a reduced form of the text.
GENERIC_NEEDS = {
    "Aadhaar": ("packed", ("0" * 12,)), "PAN": ("shape", ("AAAAA0000A",)), "Passport": ("shape", ("A0000000",)),
    "VoterID": ("text", ("EPIC/",)), "DrivingLicense": ("shape", ("AA-0000-0000000",)), "BankAccount": ("shape", ("0" * 10,)),
    "IFSC": ("shape", ("AAAA0",)), "CreditCard": ("packed", ("0" * 16,)), "Phone": ("low", ("phone", "mobile", "contact")),
    "DOB": ("low", ("dateofbirth", "dob", "born")), "Name": ("low", ("name", "person")), "Address": ("low", ("address", "location")),
    "EmployeeID": ("low", ("employeeid", "emp")), "StudentRoll": ("low", ("roll", "studentid")),
    "TransactionID": ("low", ("transaction", "txn", "reference")), "Salary": ("low", ("salary", "income", "amount")),
    "GPS": ("shape", ("0.000000",)), "APIKey": ("low", ("api", "secret", "token")), "Username": ("low", ("user",)),
    "Password": ("low", ("password", "passwd", "pwd")), "GSTIN": ("shape", ("00AAAAA0000A0",)), "LinkedinProfile": ("low", ("linkedin", "in.com")),
}

# Document classes.  (class, keywords, expected types, most hits)
DOCUMENT_CLASSES = [
    ("AADHAAR", ["aadhaar", "aadhar", "unique identification", "uidai", "government of india"], ["aadhaar", "phone", "dob"], 4),
    ("PAN", ["pan", "permanent account number", "income tax"], ["pan", "dob", "phone"], 3),
    ("PASSPORT", ["passport", "republic of india", "nationality", "passport no"], ["passport", "dob"], 2),
    ("VOTER_ID", ["voter", "election", "elector", "epic no"], ["voter_id", "dob"], 2),
    ("DRIVING_LICENSE", ["driving licence", "driving license", "dl no", "transport"], ["driving_license", "dob"], 2),
    ("BANK_STATEMENT", ["bank", "statement", "account", "ifsc", "branch"], ["bank_account", "ifsc", "phone", "email"], 4),
    ("GST_CERTIFICATE", ["gstin", "gst", "goods and services tax"], ["gstin", "pan", "phone", "email"], 4),
    ("RATION_CARD", ["ration card", "food", "civil supplies"], ["ration_card", "aadhaar"], 2),
    ("MEDICAL_RECORD", ["hospital", "medical", "patient", "prescription", "doctor"], ["medical_record_id", "phone", "dob", "aadhaar"], 4),
    ("INSURANCE_POLICY", ["insurance", "policy", "premium", "sum assured"], ["insurance_policy_no", "pan", "phone", "email", "dob"], 5),
]

# Other names a type goes by (looked up in upper case).
TYPE_ALIASES = {
    "AADHAAR": "aadhaar", "PAN_CARD": "pan", "PAN": "pan", "PHONE_NUMBER": "phone",
    "PHONE": "phone", "MOBILE": "phone", "DOB": "dob", "DATE_OF_BIRTH": "dob",
    "PASSPORT_NO": "passport", "PASSPORT": "passport", "VOTER_ID": "voter_id",
    "EPIC": "voter_id", "DRIVING_LICENSE": "driving_license", "DL": "driving_license",
    "BANK_ACCOUNT": "bank_account", "ACCOUNT_NO": "bank_account", "IFSC": "ifsc",
    "GSTIN": "gstin", "GST": "gstin", "RATION_CARD": "ration_card",
    "MEDICAL_RECORD": "medical_record_id", "INSURANCE_POLICY": "insurance_policy_no",
    "EMAIL": "email",
}


def shape_catalog() -> list[Pattern]:
    """The 42 shape patterns, in scan order, with their claim priority."""
    rank = {t: i for i, t in enumerate(SHAPE_PRIORITY)}
    return [
        Pattern(t, rx, ic, None, None, conf, rank[t], guard, group, SHAPE_NEEDS.get(t), True)
        for t, rx, ic, group, conf, guard in SHAPES
    ]


def spellings(label: str) -> tuple[str, ...]:
    """What a label pattern may read before its separator, in lower case and without blanks, ended by a colon."""
    head = re.split(r"\\s\*\[:=\]", label)[0].replace(r"[_\s]?", "_?").replace(r"\s*", "").replace("(?:", "(")

    def choice(i):
        """The readings of the alternatives that start at ``i``, and where they end."""
        done, now = [], [""]
        while i < len(head) and head[i] != ")":
            if head[i] == "|":
                done, now, i = done + now, [""], i + 1
                continue
            part, i = choice(i + 1) if head[i] == "(" else ([head[i]], i + 1)
            if head[i:i + 1] == "?":
                part, i = [*part, ""], i + 1
            now = [a + b for a in now for b in part]
        return done + now, i + 1

    return tuple(dict.fromkeys(x.lower() + ":" for x in choice(0)[0]))


def label_catalog() -> list[Pattern]:
    """One entry per label pattern; priority is the position in the catalog."""
    flat = [(name, cat, rx) for name, cat, patterns in LABELS for rx in patterns]
    return [
        Pattern(name, rx, True, cat, name.replace("_", " "), 0.95, i, "separator", 1, ("heads", spellings(rx)), True)
        for i, (name, cat, rx) in enumerate(flat)
    ]


def generic_catalog(category: str | None = None) -> list[Pattern]:
    """The generic patterns; with ``category`` only those that can yield it."""
    return [
        Pattern(t, rx, ic, cat, label, 0.95, i, guard, 0, GENERIC_NEEDS.get(t), True)
        for i, (t, label, cat, rx, ic, guard) in enumerate(GENERIC)
        if category is None or cat == category
    ]


#: Flags that a caller's pattern may carry, as in the usual inline form.
FLAGS = "imsx"
# texts on which a pattern of a caller is tried before any document is
TRIALS = [unit * (20_000 // len(unit)) for unit in ("a", "1", " ", "a ", "a.", "a1-", "ab@")]


def user_catalog(rows, engine=None) -> list[Pattern]:
    """A caller's own patterns from (type, regex[, confidence[, category[, flags[, group]]]]) rows.

    ``flags`` are letters of ``FLAGS``, ``group`` is the group that holds the value (0: the whole match).  With
    ``engine``, a JVM gateway, each pattern is tried there first: one that is no pattern, lacks its group, matches the
    empty text, or overflows the stack on a long simple text is refused with a ValueError.
    """
    out = []
    for i, row in enumerate(rows):
        t, rx, confidence, category, flags, group = [*row, *[0.5, None, "", 0][len(row) - 2:]]
        if set(flags or "") - set(FLAGS):
            raise ValueError(f"{t}: flags are letters of {FLAGS}")
        regex = f"(?{flags}){rx}" if flags else rx
        if engine is not None:
            _try_out(engine, t, regex, group)
        out.append(Pattern(t, regex, False, category, t, confidence, i, None, group))
    return out


def _try_out(engine, name: str, regex: str, group: int) -> None:
    try:
        compiled = engine.java.util.regex.Pattern.compile("(?U)" + regex)
        if compiled.matcher("").groupCount() < group:
            raise ValueError(f"{name}: there is no group {group}")
        if compiled.matcher("").find():
            raise ValueError(f"{name}: the pattern matches the empty text")
        for text in TRIALS:
            found = compiled.matcher(text)
            if found.find() and found.start() == found.end():
                raise ValueError(f"{name}: the pattern matches the empty text")
    except ValueError:
        raise
    except Exception as e:  # a Java error, told apart only by its text
        why = "overflows on a long text" if "StackOverflow" in str(e) else "is no pattern"
        raise ValueError(f"{name}: the pattern {why}") from e
