"""parlance.plans"""
