"""Part of dossier."""
