"""parlance.functions"""
