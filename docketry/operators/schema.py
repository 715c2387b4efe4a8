"""Schemas of the records that operators take and return."""

from __future__ import annotations

FIXED = "array<struct<libelle_original:string,valeur_originale:string,valeur_millimes:bigint,accorde_banque:boolean,fixe:boolean,include_dans_total:boolean,raison_inclusion_exclusion:string>>"
VARIABLE = "array<struct<libelle_original:string,formule_originale:string,raison_non_calculable:string>>"
FIELDS = {
    "tribunal": "string",
    "numero_dossier": "string",
    "date_decision": "string",
    "type_jugement": "string",
    "role_banque": "string",
    "parties": "struct<demandeur:string,defendeur:string>",
    "montants_fixes": FIXED,
    "montants_variables": VARIABLE,
    "montant": "string",
    "explication_montant": "string",
    "montant_justification": "string",
    "references_juridiques": "array<string>",
    "decision": "string",
    "decision_justification": "string",
    "resume": "string",
}
RECORD = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
#: Flat columns of the registry that are promoted from the record.
PROMOTED = ("tribunal", "numero_dossier", "date_decision", "demandeur", "defendeur", "montant", "explication_montant", "references_juridiques", "decision", "decision_justification", "resume")
WORDS = "doc_id long, page int, psm string, idx int, block_num int, par_num int, line_num int, text string, conf double"
