"""Part of hushgrad; see the README for what lives here."""
