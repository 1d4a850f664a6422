"""The wanted fields of the two kinds of upload, and the headers under which files carry them."""

#: Field -> plain headers (lower case, runs of other characters as one space).
CENSUS = {
    "employee_first_name": ("employee first name", "first name", "forename", "given name"),
    "employee_last_name": ("employee last name", "last name", "surname", "family name"),
    "employee_id": ("employee id", "employee number", "emp nbr", "staff no", "emp id", "ee id"),
    "state": ("state", "tax state", "work state"),
    "gross_annual_taxable_wages": ("gross annual taxable wages", "annual salary", "yearly gross", "wages p a", "taxable wages yearly", "annual gross"),
    "pay_frequency": ("pay frequency", "pay freq", "pay periods", "of pays year", "how often paid", "payroll cycle"),
    "federal_w4_marital_status": ("federal w 4 marital status", "filing status", "w4 status", "marital status"),
    "w4_year": ("w4 year", "w 4 year", "federal w 4 year"),
    "dependents": ("dependents", "no of dependants", "federal w 4 dependents claimed", "number of dependents"),
    "step2c": ("step2c", "step 2c", "step 2 c", "multiple jobs"),
    "step3": ("step3", "step 3"),
    "group_health_monthly": ("group health monthly", "group health employee monthly contribution", "health contribution mo", "medical ee share"),
    "other_monthly_pretax": ("other monthly pretax", "other monthly pre tax", "other pre tax monthly"),
    "retirement_401k_monthly": ("retirement 401k monthly", "401 k ira monthly amount", "pension contribution", "retirement per month"),
    "additional_federal": ("additional federal", "additional federal withholding", "extra federal"),
    "additional_state": ("additional state", "additional state withholding", "extra state"),
    "census_socialsec": ("census socialsec", "socialsec", "social security", "pays ss"),
    "census_medicare": ("census medicare", "medicare", "pays medicare"),
}
PROPOSAL = {
    "first_name": ("first name", "forename", "given name"),
    "last_name": ("last name", "surname", "family name"),
    "client_employee_id": ("client employee id", "client ref", "employee id"),
    "annual_salary": ("annual salary", "salary with buffer", "yearly pay"),
    "federal_tax_before_premium": ("federal tax before premium", "federal tax before", "fit before premium"),
    "federal_savings": ("federal savings", "fed tax saved", "fit reduction"),
    "state_savings": ("state savings", "state tax saved", "sit reduction"),
    "social_security_savings": ("social security savings", "ss savings"),
    "medicare_savings": ("medicare savings", "med savings"),
    "ee_gross_monthly_savings": ("ee gross monthly savings", "gross monthly savings"),
    "ee_monthly_fee": ("ee monthly fee", "monthly fee", "employee charge"),
    "employee_monthly_allotment": ("employee monthly allotment", "monthly allotment", "emp allot", "allotment ee", "net gain per month"),
    "taxable_income_before": ("taxable income before", "taxable before"),
    "taxable_income_after": ("taxable income after", "taxable after"),
    "wellness_program": ("wellness program", "wellness premium", "programme premium"),
}
#: slot -> plain header -> field.
SYNONYMS = {slot: {h: f for f, own in table.items() for h in own} for slot, table in (("census", CENSUS), ("proposal", PROPOSAL))}
#: Fields whose canonical value is a number.
NUMBERS = frozenset("gross_annual_taxable_wages dependents step3 group_health_monthly other_monthly_pretax retirement_401k_monthly additional_federal additional_state".split()) | (frozenset(PROPOSAL) - {"first_name", "last_name", "client_employee_id"})
