"""Part of colsift."""
