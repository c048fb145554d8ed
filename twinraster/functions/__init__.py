"""Part of twinraster."""
