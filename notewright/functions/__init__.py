"""Part of notewright; see the README."""
